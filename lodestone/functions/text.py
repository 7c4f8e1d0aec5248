"""Scalar functions on prompts: stripping, labels, families, slices, templates, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define families and slices.
JAILBREAK = (
    r"(?-i:\bDAN\b)|do anything now|jailbr[eo]a?k"
    r"|ignore (?:all |any |your |the )?(?:previous |prior |above )?(?:instructions|rules|guidelines|restrictions)"
    r"|developer mode|dev mode|god mode|unfiltered|uncensored"
    r"|no (?:ethical|moral) (?:guidelines|restrictions)|without (?:any )?(?:filters|restrictions|limitations)"
)
PERSONA = (
    r"(?-i:\bDAN\b)|do anything now|jailbr[eo]a?k|amoral|unfiltered|uncensored"
    r"|developer mode|dev mode|god mode"
    r"|no (?:ethical|moral) (?:guidelines|restrictions)"
    r"|without (?:any )?(?:filters|restrictions|limitations)"
    r"|act (?:as|like) (?:an? )?(?:\w+ )?(?:AI|Al|model|persona|character)"
)
CREATIVE = (
    r"\b(?:comedy|video|movie|film|play|tv|screen|youtube|podcast|stand-up|sketch|dialogue|"
    r"theat(?:er|re)|radio|speech|story|sales|marketing|interview|documentary|commercial|skit|"
    r"news|phone|call|narrative|role-?play)\s+scripts?\b"
    r"|\b(?:tv|radio|training|loyalty|educational|school|government|social|welfare|exercise|diet|"
    r"rehab\w*|mentorship|volunteer|outreach|reality|cooking|talk|news|degree|study|exchange|"
    r"internship|fitness|research|aid|assistance)\s+programs?\b"
)
CODE = (
    r"```|\bdef \w+\(|\bimport \w+|#include|<script|\bselect \* from\b|\bsudo |\bpython\b|"
    r"\bjava ?script\b|\bnode\.?js\b|\bc\+\+|\bc#|\bbash\b|\bpowershell\b|\bsql\b|\bhtml\b|\bphp\b|"
    r"\bapi\b|\bsource code\b|\bcode snippet\b|"
    r"\b(?:write|create|develop|generate|provide|give me)\s+(?:a |an |the |some )?(?:\w+ ){0,2}code\b|"
    r"\bcode (?:that|to|for)\b|\b(?:python|bash|shell|powershell|batch|php|javascript) script\b|"
    r"\bscript (?:that|to|which)\b|\b(?:computer|software) program\b|\bprogram (?:that|to|which)\b|"
    r"\b(?:browser extension|chrome extension|plugin|botnet|web scraper|scraper|keylogger)\b"
)
CYBER = (
    r"\bmalware\b|\bransomware\b|\bspyware\b|\bkeylogger\b|\btrojan\b|\brootkit\b|\bbotnet\b|"
    r"\bcomputer virus\b|\bshellcode\b|\bbackdoor\b|\breverse shell\b|\bzero[- ]day\b|\bcve-\d|"
    r"\bsql injection\b|\bxss\b|\bcross[- ]site script|\bcsrf\b|\bbuffer overflow\b|\bddos\b|"
    r"\bdos attack\b|\bbrute[- ]forc|\bprivilege escalation\b|\bpenetration test|\bpentest|"
    r"\bhack(?:ing)? into\b|\bhack (?:a|an|the|someone|my|his|her|their)\b|\bhackers?\b|"
    r"\b(?:ethical|computer|network|password|account|wifi|email) hacking\b|\bcyber ?attack|"
    r"\bcybersecurity\b|\b(?:security|software|system|network|zero-day|critical) vulnerabilit|"
    r"\bvulnerabilit(?:y|ies) in (?:the |a |an )?(?:\w+ )?(?:system|software|network|app|application|"
    r"website|server|code|firmware|browser|device|protocol)|\bexploit (?:a |the )?vulnerabilit|"
    r"\bfirewall\b|\bantivirus\b|\bpassword crack|\bcrack (?:a |the |someone's )?password|"
    r"\bphishing\b|\bspoof(?:ing|ed)? (?:email|ip|website|domain|caller|gps|mac|dns)"
)
TEMPLATE_PROMPT = r"(?i)\[?TARGETLANGUAGE\]?|\[PROMPT\]"
YES = ("yes", "harmful", "unsafe", "1", "true")
NO = ("no", "unharmful", "safe", "0", "false")
MISSING = ("", "none", "nan", "null")


def strip(x: Column) -> Column:
    """Strip white space of any script, not spaces only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    """Stripped, lower-cased, runs of white space made one space."""
    return F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", " ")


def is_jailbreak_like(x: Column) -> Column:
    return x.rlike(f"(?i){JAILBREAK}")


def jailbreak_family(x: Column) -> Column:
    """null for other prompts; the persona family goes before the injection family."""
    return F.when(
        ~is_jailbreak_like(x), F.lit(None).cast("string")
    ).when(x.rlike(f"(?i){PERSONA}"), "persona_jailbreak").otherwise("prompt_injection_template")


def slice_tag(x: Column) -> Column:
    """code, cyber or other, after phrases like 'movie script' are blanked out."""
    plain = F.regexp_replace(F.lower(x), CREATIVE, " ")
    return F.when(plain.rlike(CODE), "code").when(plain.rlike(CYBER), "cyber").otherwise("other")


def wrapped(template: Column, request: Column) -> Column:
    """Every {0} of the template replaced by the request; without one, the request after a blank line."""
    return F.when(
        F.instr(template, "{0}") > 0, F.replace(template, F.lit("{0}"), request)
    ).otherwise(F.concat(template, F.lit("\n\n"), request))


def categories(x: Column) -> Column:
    """The comma-separated names, stripped, without empty ones; null gives an empty list."""
    return F.coalesce(F.filter(F.transform(F.split(x, ","), lambda c: F.trim(c)), lambda c: c != ""), F.array().cast("array<string>"))


def primary_category(x: Column) -> Column:
    return F.get(F.filter(categories(x), lambda c: c != "Needs Caution"), F.lit(0))


def is_missing(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x.cast("string"))).isin(*MISSING)


def binary_label(x: Column) -> Column:
    """unsafe, safe, or null for values of neither list."""
    v = F.lower(F.trim(x.cast("string")))
    return F.when(v.isin(*YES), "unsafe").when(v.isin(*NO), "safe")


def harm_label(x: Column) -> Column:
    """1, 0, null if missing; any other value raises."""
    v = F.lower(F.trim(x.cast("string")))
    bad = F.raise_error(F.concat(F.lit("unexpected label: "), v)).cast("int")
    return F.when(is_missing(x), F.lit(None).cast("int")).when(v == "harmful", 1).when(v == "unharmful", 0).otherwise(bad)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def human_turns(transcript: Column) -> Column:
    """The human's turns of a transcript of "Human:" and "Assistant:" paragraphs."""
    parts = F.split(transcript, "\n\nHuman:")
    return F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: strip(F.split_part(p, F.lit("\n\nAssistant:"), F.lit(1)))
    )


def head_tail(tokens: Column, limit: int, head_share: float = 0.25) -> Column:
    """At most ``limit`` items: the first quarter of them from the head, the rest from the tail."""
    head = int(limit * head_share)
    tail = limit - head
    return F.when(F.size(tokens) <= limit, tokens).otherwise(F.concat(F.slice(tokens, 1, head), F.slice(tokens, -tail, tail)))
