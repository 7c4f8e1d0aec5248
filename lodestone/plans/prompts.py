"""Queries on prompts: scans, cleaning, categories, splits, samples and pair builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import pairs as P
from ..operators import pool as pl
from ..sources import stores
from ..sources.tables import PROMPTS, hashed, hashed_sql, load, prompts

LEAST_CATEGORY = 12


def _esc(pattern: str) -> str:
    return pattern.replace("'", "''")


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_JB, _PE = _esc(X.JAILBREAK), _esc(X.PERSONA)
_FAMILY = f"CASE WHEN NOT regexp_matches({{0}}, '(?i){_JB}') THEN NULL WHEN regexp_matches({{0}}, '(?i){_PE}') THEN 'persona_jailbreak' ELSE 'prompt_injection_template' END"

REASONS = f"""{PROMPTS},
clean AS (SELECT * REPLACE ({STRIP.format("prompt")} AS prompt) FROM prompts WHERE prompt IS NOT NULL),
held AS (SELECT DISTINCT {STRIP.format("text")} AS held FROM benchmark WHERE text IS NOT NULL),
facts AS (SELECT *, min(prompt_label) OVER (PARTITION BY prompt) <> max(prompt_label) OVER (PARTITION BY prompt) AS labels,
  row_number() OVER (PARTITION BY prompt ORDER BY id) > 1 AS copy FROM clean),
reasons AS (SELECT facts.*, CASE WHEN prompt = '' OR prompt = 'REDACTED' THEN 'redacted_or_empty' WHEN labels THEN 'inconsistent_label' WHEN copy THEN 'duplicate'
  WHEN held IS NOT NULL THEN 'in_held_out' WHEN length(prompt) < 15 OR length(prompt) > 2000 THEN 'length'
  WHEN {_FAMILY.format("prompt")} = 'persona_jailbreak' THEN 'persona_jailbreak' END AS drop_reason FROM facts LEFT JOIN held ON prompt = held)"""
CATS = "list_filter(list_transform(string_split(violated_categories, ','), lambda c: trim(c)), lambda c: c <> '')"
POOL = f"""{REASONS},
pool0 AS (SELECT id, prompt, lang, source, CASE WHEN prompt_label = 'unsafe' THEN 'harm' ELSE 'safe' END AS label, length(prompt) AS chars,
  CASE WHEN prompt_label = 'unsafe' THEN {CATS} ELSE [] END AS categories,
  CASE WHEN prompt_label = 'unsafe' THEN coalesce(list_filter({CATS}, lambda c: c <> 'Needs Caution')[1], 'Other') END AS raw_category FROM reasons WHERE drop_reason IS NULL),
cat AS (SELECT raw_category AS rc, CASE WHEN count(*) >= {LEAST_CATEGORY} OR raw_category IN ('Malware', 'Other') THEN raw_category ELSE 'Other' END AS primary_category FROM pool0 WHERE raw_category IS NOT NULL GROUP BY 1),
pool AS (SELECT pool0.*, primary_category FROM pool0 LEFT JOIN cat ON raw_category = rc)"""


def reasons(s: SparkSession, d: str) -> DataFrame:
    return pl.drop_reasons(prompts(s, d), load(s, d, "benchmark"))


def the_pool(s: SparkSession, d: str) -> DataFrame:
    return pl.merged_categories(pl.pool(prompts(s, d), load(s, d, "benchmark")), LEAST_CATEGORY)


def pool_scan(s, d):
    return pl.scan_pool(prompts(s, d))


def pool_filters(s, d):
    return reasons(s, d).select("id", "drop_reason")


def pool_filter_counts(s, d):
    return reasons(s, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


def jailbreak_family(s, d):
    c = load(s, d, "documents")
    return c.select("doc_id", X.is_jailbreak_like(F.col("text")).alias("jailbreak_like"), X.jailbreak_family(F.col("text")).alias("family"))


#: Lead-ins that give the invented texts of conversations a domain, by conv_id.
LEADS = (
    "", "Write a Python script: ", "About ransomware. ", "A movie script on malware. ", "[PROMPT] ", "Tell a story. ",
    "Fix this code for me: "
)


def slice_tags(s, d):
    """Short texts without templates, each once (the first), with their slice; other slices are dropped."""
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.pmod("conv_id", F.lit(len(LEADS))) + 1).cast("int"))
    c = load(s, d, "conversations").withColumn("text", F.concat(lead, "text")).where("text IS NOT NULL AND char_length(text) <= 15000")
    c = c.where(~F.col("text").rlike(X.TEMPLATE_PROMPT))
    first = c.groupBy("text").agg(F.min(F.struct("conv_id", "turn", "role")).alias("f"))
    return first.select("f.conv_id", "f.turn", X.slice_tag(F.col("text")).alias("slice")).where("slice <> 'other'")


def category_lists(s, d):
    c = F.col("violated_categories")
    return prompts(s, d).select(
        "id", F.array_join(X.categories(c), "|").alias("categories"), X.primary_category(c).alias("primary_category")
    )


def label_normalize(s, d):
    raw = F.element_at(F.array(*map(F.lit, ("yes", " Unharmful ", "nan", "1", "FALSE", "other"))), (F.col("doc_id") % 6 + 1).cast("int"))
    x = load(s, d, "labels").select("doc_id", raw.alias("raw"))
    return x.select(
        "doc_id", X.binary_label(F.col("raw")).alias("label"), X.is_missing(F.col("raw")).alias("missing"),
        X.truthy(F.col("raw")).alias("truthy")
    )


def any_label(s, d):
    t, j = F.coalesce("toxic", F.lit(0)) == 1, F.coalesce("quality", F.lit(0)) == 1
    cat = F.when(t & j, "toxicity+jailbreaking").when(j, "jailbreaking").when(t, "toxicity").otherwise("safe")
    return load(s, d, "labels").where("toxic IS NOT NULL OR quality IS NOT NULL").select(
        "doc_id", (t | j).cast("int").alias("label"), cat.alias("category")
    )


def text_length_profile(s, d):
    x = prompts(s, d).withColumn("chars", F.char_length("prompt"))
    q = F.percentile("chars", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    ends = F.endswith(X.strip(F.col("prompt")), F.lit("?")).cast("double")
    r = x.groupBy("lang").agg(F.count("*").alias("n"), q.alias("q"), F.avg(ends).alias("question_share"))
    return r.select(
        "lang", "n", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("median", "p90", "p95"))],
        F.round("question_share", 6).alias("question_share")
    )


def transcript_parse(s, d):
    c = load(s, d, "conversations")
    role = F.when(F.col("role") == "user", "Human").otherwise("Assistant")
    line = F.concat(F.lit("\n\n"), role, F.lit(": "), F.col("text"))
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "")
    x = c.groupBy("conv_id").agg(X.human_turns(t).alias("turns"))
    return x.select("conv_id", F.size("turns").alias("n_turns"), F.md5(F.array_join("turns", "|")).alias("turns_md5"))


def head_tail_truncate(s, d):
    w = F.split(F.col("text"), " ")
    return load(s, d, "documents").where("text IS NOT NULL").select(
        "doc_id", F.size(X.head_tail(w, 64)).alias("n"), F.md5(F.array_join(X.head_tail(w, 64), " ")).alias("kept_md5")
    )


def fingerprint(s, d):
    """SHA-1 of the texts of each source in id order, with separators: of runs of 4096 ids, of runs of those, and of all runs."""
    x = load(s, d, "documents").select(
        "source", F.col("doc_id").alias("k"), F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), F.lit(1).alias("n")
    )
    for _ in range(2):
        x = _hashed_runs(x.withColumn("run", F.floor(F.col("k") / 4096)), ["source", "run"]).withColumnRenamed("run", "k")
    return _hashed_runs(x, ["source"]).select("source", F.col("h").alias("fingerprint"), "n")


def _hashed_runs(x, by: list[str]):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda r: r["h"])
    return x.groupBy(*by).agg(F.sha1(F.array_join(rows, "\x1f").cast("binary")).alias("h"), F.sum("n").alias("n"))


def jsonl_roundtrip(s, d):
    """Conversations written as JSON lines in two folders and read together, ids as strings."""
    folder = stores.scratch(s, "lines")
    x = load(s, d, "conversations").select(F.col("conv_id").alias("id"), "role", "text", "turn")
    for k in (0, 1):
        stores.write_lines(x.where(F.pmod("turn", F.lit(2)) == k), f"{folder}/{k}", "gzip" if k else "none")
    schema = T.StructType(
        [
            T.StructField("id", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
            T.StructField("turn", T.LongType())
        ]
    )
    y = stores.read_lines(s, [f"{folder}/{k}" for k in (0, 1)], schema)
    return y.select("id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def dedup_first(s, d):
    x = load(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("text_md5"))
    return x.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"))


def label_conflicts(s, d):
    x = prompts(s, d).where("prompt IS NOT NULL").select("id", "prompt_label", F.md5("prompt").alias("h"))
    y = x.groupBy("h").agg(F.min("prompt_label").alias("lo"), F.max("prompt_label").alias("hi"))
    return x.join(y, "h").select("id", (F.col("lo") != F.col("hi")).alias("conflict"))


def heldout_anti(s, d):
    b = load(s, d, "benchmark").select(X.strip(F.col("text")).alias("t")).distinct()
    return load(s, d, "documents").where("text IS NOT NULL").select(
        "doc_id", X.strip(F.col("text")).alias("t")
    ).join(b, "t", "left_anti").select("doc_id")


def eval_clean(s, d):
    train = load(s, d, "documents").join(load(s, d, "labels"), "doc_id").where("quality = 1").select(
        X.strip(F.col("text")).alias("t")
    ).distinct()
    x = prompts(s, d).where(
        "quality = 0 AND prompt IS NOT NULL"
    ).withColumn("t", X.strip(F.col("prompt"))).where("t <> '' AND t <> 'REDACTED'")
    x = pl.one_label(x.join(train, "t", "left_anti"), "t", "prompt_label")
    return pl.first_of(x, "t", "id").select("id", "prompt_label")


def eval_normalize(s, d):
    raw = F.when(F.col("doc_id") % 11 == 0, F.lit("none")).when(F.col("toxic") == 1, " Harmful").otherwise("unharmful")
    x = load(s, d, "documents").join(load(s, d, "labels"), "doc_id").select(
        "doc_id", X.strip(F.coalesce("text", F.lit(""))).alias("text"), X.harm_label(raw).alias("label")
    )
    x = x.where("char_length(text) BETWEEN 3 AND 8000 AND label IS NOT NULL")
    return pl.first_of(pl.one_label(x, "text", "label"), "text", "doc_id").select("doc_id", "label")


def category_merge(s, d):
    x = the_pool(s, d).where("label = 'harm'").groupBy("primary_category").agg(F.count("*").alias("n"))
    return x.select("primary_category", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


def contrast_pairs(s, d):
    """User turn and reply at each (conversation, turn): a 1:1 join, unique keys enforced."""
    c = load(s, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("k"), "role", F.char_length("text").alias("chars")
    )
    side = lambda r, shift, n: c.where(F.col("role") == r).select((F.col("k") + shift).alias("k"), F.col("chars").alias(n))
    a, b = side("user", 0, "user_chars"), side("assistant", -1, "reply_chars")
    once = lambda x: x.groupBy("k").agg(F.count("*").alias("n"), F.first(x.columns[1]).alias(x.columns[1])).where(
        F.when(F.col("n") > 1, F.raise_error(F.lit("key is not unique")).cast("boolean")).otherwise(True)
    ).drop("n")
    j = once(a).join(once(b), "k").where("user_chars <= 15000 AND reply_chars <= 15000")
    return j.select("k", "user_chars", "reply_chars", F.lit("conversations").alias("source_id"))


def _pairs(s, d):
    """Random contrast pairs of the pool with both sides."""
    p = the_pool(s, d).select("id", "prompt", "label", "primary_category")
    r = P.random_pairs(p, 1 << 30)
    a = r.join(
        p.select(
            F.col("id").alias("harm_id"), F.col("prompt").alias("anchor_text"), F.col("label").alias("anchor_label"),
            F.col("primary_category").alias("anchor_category")
        ),
        "harm_id"
    )
    return a.join(p.select(F.col("id").alias("safe_id"), F.col("prompt").alias("pair_text"), F.col("label").alias("pair_label"), F.col("primary_category").alias("pair_category")), "safe_id").select(
        F.col("position").alias("pair_id"), F.lit("safe_harm_contrast").alias("pair_type"), "anchor_text", "anchor_label",
        "anchor_category", "pair_text", "pair_label", "pair_category", "harm_id", "safe_id"
    )


PAIRS = f"""{POOL}, rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hashed_sql("id")}, id) AS position FROM pool),
pr AS (SELECT a.position AS pair_id, 'safe_harm_contrast' AS pair_type, a.prompt AS anchor_text, a.label AS anchor_label, a.primary_category AS anchor_category, b.prompt AS pair_text, b.label AS pair_label, b.primary_category AS pair_category, a.id AS harm_id, b.id AS safe_id
  FROM rk a JOIN rk b ON a.position = b.position AND a.label = 'harm' AND b.label = 'safe')"""


def safe_harm_random(s, d):
    return _pairs(s, d).select("pair_id", "harm_id", "safe_id")


def _wrapped_pairs(s, d):
    p = the_pool(s, d).where("chars <= 1000").where(~X.is_jailbreak_like(F.col("prompt")))
    w = P.wraps(p, P.templates(s), 2)
    kind = F.when(F.col("label") == "harm", "jailbreak_variant").otherwise("benign_twin")
    return w.select(
        F.lit(None).cast("int").alias("pair_id"), kind.alias("pair_type"), F.col("prompt").alias("anchor_text"),
        F.col("label").alias("anchor_label"), F.col("primary_category").alias("anchor_category"), F.col("wrapped").alias("pair_text"),
        F.col("label").alias("pair_label"), F.col("primary_category").alias("pair_category")
    )


_T = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(P.TEMPLATES))
TEMPLATE_ROWS = f"tmpl(template_id, template) AS (VALUES {_T})"
WRAP = "CASE WHEN instr(template, '{{0}}') > 0 THEN replace(template, '{{0}}', {0}) ELSE template || chr(10) || chr(10) || {0} END"
WRAPS = f"""{PAIRS}, {TEMPLATE_ROWS},
el AS (SELECT * FROM pool WHERE chars <= 1000 AND NOT regexp_matches(prompt, '(?i){_JB}')),
wr AS (SELECT * FROM (SELECT el.*, template_id, {WRAP.format("prompt")} AS wrapped, row_number() OVER (PARTITION BY id ORDER BY {hashed_sql("concat_ws(':', CAST(id AS VARCHAR), CAST(template_id AS VARCHAR))")}, template_id) AS rn FROM el, tmpl) WHERE rn <= 2),
wp AS (SELECT CASE WHEN label = 'harm' THEN 'jailbreak_variant' ELSE 'benign_twin' END AS pair_type, prompt AS anchor_text, label AS anchor_label, primary_category AS anchor_category, wrapped AS pair_text, label AS pair_label, primary_category AS pair_category FROM wr),
allp AS (SELECT pair_type, anchor_text, anchor_label, anchor_category, pair_text, pair_label, pair_category FROM pr UNION ALL SELECT * FROM wp)"""


def _all_pairs(s, d):
    return _pairs(s, d).drop("harm_id", "safe_id").unionByName(_wrapped_pairs(s, d))


def wrap_variants(s, d):
    p = the_pool(s, d).where("chars <= 1000").where(~X.is_jailbreak_like(F.col("prompt")))
    return P.wraps(p, P.templates(s), 2).select("id", "template_id", F.md5("wrapped").alias("wrapped_md5"))


def wrap_variants_v1(s, d):
    p = the_pool(s, d).withColumn("context", F.when(F.col("id") % 2 == 0, F.col("source")).otherwise(""))
    return P.wraps(p, P.templates(s), 2, context="context", substitute=False).select(
        "id", "template_id", F.md5("wrapped").alias("wrapped_md5")
    )


def pair_unpivot(s, d):
    u = P.unpivoted(_pairs(s, d))
    r = pl.ranked(u, ["text"], [F.col("side"), F.col("pair_id")], "rn").where("rn = 1")
    code = F.when(F.col("label") == "harm", 1).when(F.col("label") == "safe", 0)
    return r.select("pair_id", "side", code.alias("y"), "category")


def pairs_union(s, d):
    return _all_pairs(s, d).groupBy("pair_type", "anchor_label", "pair_label").agg(F.count("*").alias("n"))


def _stored_pairs(s, d, version: int) -> str:
    """The folder of all pairs, written as JSON lines with a manifest; ids are ranks at random."""
    folder = stores.scratch(s, f"pairs-v{version}")
    keyed = _all_pairs(s, d).withColumn("key", F.concat_ws("\x1f", "pair_type", "anchor_text", "pair_text"))
    stores.write_pairs(pl.shuffled(keyed, [], "key", name="id"), folder, version)
    return folder


def unique_texts_by_label(s, d):
    """Read back from the stored pairs."""
    x = stores.read_pairs(s, [_stored_pairs(s, d, 2)], 2).withColumn("id", F.lit("0"))
    return stores.first_labels(x).groupBy("label").agg(F.count("*").alias("n"))


def pairs_v1_manifest(s, d):
    """Counts by type and category as the manifest of the stored pairs has them, where the stored rows agree."""
    folder = _stored_pairs(s, d, 1)
    rows = P.side_counts(stores.read_pairs(s, [folder], 1), F.col("anchor_category"), "(none)")
    return stores.manifest_rows(s, folder, 1).join(rows, ["pair_type", "category", "n"])


def pairs_v2_manifest(s, d):
    """The same by the category of the harmful side."""
    folder = _stored_pairs(s, d, 2)
    rows = P.side_counts(stores.read_pairs(s, [folder], 2), stores.harm_category(), "(safe only)")
    return stores.manifest_rows(s, folder, 2).join(rows, ["pair_type", "category", "n"])


def dataset_profile(s, d):
    x = prompts(s, d).withColumn("chars", F.char_length("prompt"))
    return x.groupBy("source").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("harm"), F.sum(1 - F.col("toxic")).alias("safe"),
        F.round(F.avg("toxic"), 6).alias("harm_rate"), F.round(F.avg((F.col("lang") != "en").cast("double")), 6).alias("adversarial_share"),
        F.median("chars").alias("median_chars")
    )


def style_cells(s, d):
    x = prompts(s, d).where("toxic IS NOT NULL").withColumn("style", F.when(F.col("lang") == "en", "vanilla").otherwise("adversarial"))
    return x.groupBy("style").pivot("prompt_label", ["safe", "unsafe"]).count().select(
        "style", F.coalesce("safe", F.lit(0)).alias("safe"), F.coalesce("unsafe", F.lit(0)).alias("unsafe")
    )


def balanced_take(s, d):
    x = pl.shuffled(prompts(s, d).select("id", "toxic"), ["toxic"], "id")
    size = x.groupBy("toxic").agg(F.count("*").alias("n")).agg(F.least(F.min("n"), F.lit(1000)).alias("m"))
    return x.crossJoin(F.broadcast(size)).where("rank <= m").select("id", "toxic")


def stratified_split(s, d):
    return pl.split_by_label(prompts(s, d), 0.1, "toxic", "id").select("id", "toxic", "part")


def stratified_folds(s, d):
    return pl.folds_by_label(prompts(s, d), 5, "toxic", "id").select("id", "fold")


def pair_kfold(s, d):
    return pl.even_folds(load(s, d, "documents").select("doc_id"), 7, "doc_id").select("doc_id", "fold")


def group_split(s, d):
    return pl.split_groups(prompts(s, d).select("id", "source"), "source").select("id", "part")


def group_kfold(s, d):
    return pl.folds_of_groups(prompts(s, d).select("id", "source"), 4, "source").select("id", "fold")


def template_bank(s, d):
    return P.templates(s).withColumn("has_placeholder", F.instr("template", "{0}") > 0)


def code_contrast(s, d):
    return P.code_contrast(P.bank(s)).select("category", "harm_index", "safe_index", "harm_text", "safe_text")


def code_paraphrase(s, d):
    return P.code_paraphrase(P.bank(s)).select("category", "kind", "first", "second", "first_text", "second_text")


def code_wrapped(s, d):
    return P.code_wrapped(P.bank(s), P.templates(s), 3)


def sqrt_allocation(s, d):
    """Half of the harm prompts, split over their categories by square roots."""
    harm = the_pool(s, d).where("label = 'harm'")
    return pl.allocated(harm.groupBy(F.col("primary_category").alias("category")).agg(F.count("*").alias("available")), share=0.5)


def sqrt_sample(s, d):
    return pl.sampled_by_category(the_pool(s, d).where("label = 'harm'"), share=0.5).select("id", "primary_category")


def category_batches(s, d, batches: int = 20, per_batch: int = 3, rows: int = 2):
    """Batches of the sampler: categories without replacement by square-root weights, rows of each at random."""
    from ..sources.tables import uniform

    p = the_pool(s, d).where("label = 'harm'").select("id", "primary_category")
    cats = p.groupBy("primary_category").agg(F.count("*").alias("n")).where(F.col("n") >= rows)
    steps = cats.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    u = uniform(F.concat_ws(":", F.col("step").cast("string"), "primary_category"), "batch")
    chosen = pl.ranked(
        steps.withColumn("k", F.round(-F.log(u + 1e-12) / F.sqrt(F.col("n").cast("double")), 9)), ["step"],
        [F.col("k"), F.col("primary_category")]
    ).where(F.col("rank") <= per_batch).drop("rank", "k", "n")
    x = chosen.join(p, "primary_category")
    order = hashed(F.concat_ws(":", F.col("step").cast("string"), F.col("id").cast("string")), "row")
    return pl.ranked(
        x, ["step", "primary_category"], [order, F.col("id")]
    ).where(F.col("rank") <= rows).select("step", "primary_category", "id")


def positive_weights(s, d, alpha: float = 0.5, beta: float = 0.1):
    """Weights between the rows of each batch."""
    b = category_batches(s, d).join(the_pool(s, d).select("id", "source", "lang"), "id")
    a, c = b.alias("a"), b.alias("c")
    j = a.join(c, (F.col("a.step") == F.col("c.step")) & (F.col("a.id") != F.col("c.id")))
    w = F.when(
        (F.col("a.source") == F.col("c.source")) & (F.col("a.lang") == F.col("c.lang")), 1.0
    ).when(F.col("a.primary_category") == F.col("c.primary_category"), alpha).otherwise(beta)
    return j.select(F.col("a.step").alias("step"), F.col("a.id").alias("a"), F.col("c.id").alias("b"), w.alias("weight"))


_HALF = "hc AS (SELECT primary_category AS category, count(*) AS available FROM pool WHERE label = 'harm' GROUP BY 1), " + pl.allocated_sql(
    "hc", wanted="floor(sum(available) OVER () * 0.5::DOUBLE)"
)
_RAW = "(['yes', ' Unharmful ', 'nan', '1', 'FALSE', 'other'])[doc_id % 6 + 1]"
_BANK = "bank(category, malicious, benign_twin) AS (VALUES " + ", ".join(f"('{c}', {list(m)!r}, {list(b)!r})" for c, m, b in P.BANK) + ")"

ORACLE_SQL = {
    "pool_scan": f"WITH {PROMPTS} SELECT id, prompt, prompt_label, violated_categories FROM prompts WHERE prompt_label IN ('safe', 'unsafe')",
    "pool_filters": f"WITH {REASONS} SELECT id, drop_reason FROM reasons",
    "pool_filter_counts": f"WITH {REASONS} SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM reasons GROUP BY 1",
    "jailbreak_family": f"SELECT doc_id, regexp_matches(text, '(?i){_JB}') AS jailbreak_like, {_FAMILY.format('text')} AS family FROM documents",
    "slice_tags": f"""WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '{X.CREATIVE}', ' ', 'g') AS t FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn, role) AS rn FROM (SELECT * REPLACE ({list(LEADS)!r}[conv_id % {len(LEADS)} + 1] || text AS text) FROM conversations) WHERE text IS NOT NULL AND length(text) <= 15000 AND NOT regexp_matches(text, '{X.TEMPLATE_PROMPT}')) WHERE rn = 1),
g AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '{X.CODE}') THEN 'code' WHEN regexp_matches(t, '{_esc(X.CYBER)}') THEN 'cyber' ELSE 'other' END AS slice FROM c) SELECT * FROM g WHERE slice <> 'other'""",
    "category_lists": f"WITH {PROMPTS} SELECT id, array_to_string({CATS}, '|') AS categories, list_filter({CATS}, lambda c: c <> 'Needs Caution')[1] AS primary_category FROM prompts",
    "label_normalize": f"WITH r AS (SELECT doc_id, lower(trim({_RAW})) AS v FROM labels) SELECT doc_id, CASE WHEN v IN {X.YES} THEN 'unsafe' WHEN v IN {X.NO} THEN 'safe' END AS label, v IN {X.MISSING} AS missing, v IN ('true', '1', 'yes') AS truthy FROM r",
    "any_label": "SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 0) = 1 THEN 1 ELSE 0 END AS label, CASE WHEN coalesce(toxic, 0) = 1 AND coalesce(quality, 0) = 1 THEN 'toxicity+jailbreaking' WHEN coalesce(quality, 0) = 1 THEN 'jailbreaking' WHEN coalesce(toxic, 0) = 1 THEN 'toxicity' ELSE 'safe' END AS category FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL",
    "text_length_profile": f"WITH {PROMPTS} SELECT lang, count(*) AS n, round(quantile_cont(length(prompt), 0.5), 6) AS median, round(quantile_cont(length(prompt), 0.9), 6) AS p90, round(quantile_cont(length(prompt), 0.95), 6) AS p95, round(avg(CASE WHEN {STRIP.format('prompt')} LIKE '%?' THEN 1.0 ELSE 0.0 END), 6) AS question_share FROM prompts GROUP BY lang",
    "transcript_parse": f"""WITH t AS (SELECT conv_id, string_agg(chr(10) || chr(10) || CASE WHEN role = 'user' THEN 'Human' ELSE 'Assistant' END || ': ' || text, '' ORDER BY turn, role) AS t FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_transform(string_split(t, chr(10) || chr(10) || 'Human:')[2:], lambda x: {STRIP.format("string_split(x, chr(10) || chr(10) || 'Assistant:')[1]")}) AS turns FROM t)
SELECT conv_id, CAST(len(turns) AS INTEGER) AS n_turns, md5(array_to_string(turns, '|')) AS turns_md5 FROM p""",
    "head_tail_truncate": "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, CASE WHEN len(w) <= 64 THEN w ELSE list_concat(w[1:16], w[-48:]) END AS k FROM w) SELECT doc_id, CAST(len(k) AS INTEGER) AS n, md5(array_to_string(k, ' ')) AS kept_md5 FROM k",
    "fingerprint": """WITH f0 AS (SELECT source, doc_id AS k, sha1(coalesce(text, '')) AS h, 1 AS n FROM documents),
f1 AS (SELECT source, k // 4096 AS r, sha1(string_agg(h, chr(31) ORDER BY k, h)) AS h, sum(n) AS n FROM f0 GROUP BY ALL),
f2 AS (SELECT source, r // 4096 AS r2, sha1(string_agg(h, chr(31) ORDER BY r, h)) AS h, sum(n) AS n FROM f1 GROUP BY ALL)
SELECT source, sha1(string_agg(h, chr(31) ORDER BY r2, h)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM f2 GROUP BY source""",
    "jsonl_roundtrip": "SELECT CAST(conv_id AS VARCHAR) AS id, turn, role, md5(coalesce(text, '')) AS text_md5 FROM conversations",
    "dedup_first": "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text",
    "label_conflicts": f"WITH {PROMPTS} SELECT id, min(prompt_label) OVER (PARTITION BY prompt) <> max(prompt_label) OVER (PARTITION BY prompt) AS conflict FROM prompts WHERE prompt IS NOT NULL",
    "heldout_anti": f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {STRIP.format('text')} NOT IN (SELECT {STRIP.format('text')} FROM benchmark WHERE text IS NOT NULL)",
    "eval_clean": f"""WITH {PROMPTS}, e AS (SELECT id, prompt_label, quality, {STRIP.format('prompt')} AS t FROM prompts WHERE prompt IS NOT NULL),
f AS (SELECT * FROM e WHERE quality = 0 AND t <> '' AND t <> 'REDACTED' AND t NOT IN (SELECT t FROM e WHERE quality = 1))
SELECT min(id) AS id, min(prompt_label) AS prompt_label FROM f GROUP BY t HAVING min(prompt_label) = max(prompt_label)""",
    "eval_normalize": f"""WITH e AS (SELECT doc_id, {STRIP.format("coalesce(text, '')")} AS t, toxic AS label FROM documents JOIN labels USING (doc_id) WHERE doc_id % 11 <> 0 AND toxic IS NOT NULL)
SELECT min(doc_id) AS doc_id, min(label) AS label FROM e WHERE length(t) BETWEEN 3 AND 8000 GROUP BY t HAVING min(label) = max(label)""",
    "category_merge": f"WITH {POOL} SELECT primary_category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pool WHERE label = 'harm' GROUP BY 1",
    "contrast_pairs": "SELECT a.conv_id * 100 + a.turn AS k, length(a.text) AS user_chars, length(b.text) AS reply_chars, 'conversations' AS source_id FROM conversations a JOIN conversations b ON a.conv_id * 100 + a.turn = b.conv_id * 100 + b.turn - 1 AND a.role = 'user' AND b.role = 'assistant' WHERE length(a.text) <= 15000 AND length(b.text) <= 15000",
    "safe_harm_random": f"WITH {PAIRS} SELECT pair_id, harm_id, safe_id FROM pr",
    "wrap_variants": f"WITH {WRAPS} SELECT id, template_id, md5(wrapped) AS wrapped_md5 FROM wr",
    "wrap_variants_v1": f"""WITH {POOL}, {TEMPLATE_ROWS}, w AS (SELECT id, template_id, template || chr(10) || chr(10) || CASE WHEN id % 2 = 0 AND source <> '' THEN source || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || prompt AS wrapped,
row_number() OVER (PARTITION BY id ORDER BY {hashed_sql("concat_ws(':', CAST(id AS VARCHAR), CAST(template_id AS VARCHAR))")}, template_id) AS rn FROM pool, tmpl) SELECT id, template_id, md5(wrapped) AS wrapped_md5 FROM w WHERE rn <= 2""",
    "pair_unpivot": f"""WITH {PAIRS}, u AS (SELECT pair_id, 0 AS side, anchor_text AS text, anchor_label AS label, anchor_category AS category FROM pr UNION ALL SELECT pair_id, 1, pair_text, pair_label, pair_category FROM pr),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY side, pair_id) AS rn FROM u) SELECT pair_id, side, CASE label WHEN 'harm' THEN 1 WHEN 'safe' THEN 0 END AS y, category FROM r WHERE rn = 1""",
    "pairs_union": f"WITH {WRAPS} SELECT pair_type, anchor_label, pair_label, count(*) AS n FROM allp GROUP BY ALL",
    "unique_texts_by_label": f"WITH {WRAPS}, u AS (SELECT 0 AS side, anchor_text AS text, anchor_label AS label FROM allp UNION ALL SELECT 1, pair_text, pair_label FROM allp), f AS (SELECT text, arg_min(label, (side, label)) AS label FROM u GROUP BY text) SELECT label, count(*) AS n FROM f GROUP BY label",
    "pairs_v1_manifest": f"WITH {WRAPS} SELECT pair_type, coalesce(nullif(anchor_category, ''), '(none)') AS category, count(*) AS n FROM allp GROUP BY 1, 2",
    "pairs_v2_manifest": f"WITH {WRAPS} SELECT pair_type, coalesce(nullif(CASE WHEN anchor_label = 'harm' THEN coalesce(anchor_category, 'Other') WHEN pair_label = 'harm' THEN coalesce(pair_category, 'Other') END, ''), '(safe only)') AS category, count(*) AS n FROM allp GROUP BY 1, 2",
    "dataset_profile": f"WITH {PROMPTS} SELECT source, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS harm, CAST(sum(1 - toxic) AS BIGINT) AS safe, round(avg(toxic), 6) AS harm_rate, round(avg(CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END), 6) AS adversarial_share, median(length(prompt)) AS median_chars FROM prompts GROUP BY source",
    "style_cells": f"WITH {PROMPTS} SELECT CASE WHEN lang = 'en' THEN 'vanilla' ELSE 'adversarial' END AS style, count(*) FILTER (prompt_label = 'safe') AS safe, count(*) FILTER (prompt_label = 'unsafe') AS unsafe FROM prompts WHERE toxic IS NOT NULL GROUP BY 1",
    "balanced_take": f"WITH {PROMPTS}, r AS (SELECT id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {hashed_sql('id')}, id) AS rn FROM prompts) SELECT id, toxic FROM r WHERE rn <= (SELECT least(min(n), 1000) FROM (SELECT count(*) AS n FROM prompts GROUP BY toxic))",
    "stratified_split": f"WITH {PROMPTS}, r AS (SELECT id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {hashed_sql('id')}, id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM prompts) SELECT id, toxic, CASE WHEN rn <= round_even(n * 0.1::DOUBLE, 0) THEN 'taken' ELSE 'rest' END AS part FROM r",
    "stratified_folds": f"WITH {PROMPTS} SELECT id, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {hashed_sql('id')}, id) - 1) % 5 AS INTEGER) AS fold FROM prompts",
    "pair_kfold": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hashed_sql('doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r",
    "group_split": f"WITH {PROMPTS}, z AS (SELECT source, count(*) AS size FROM prompts GROUP BY source), c AS (SELECT source, coalesce(sum(size) OVER (ORDER BY {hashed_sql('source')}, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(size) OVER () AS start FROM z) SELECT id, CASE WHEN start < 0.2 THEN 'test' WHEN start < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS part FROM prompts JOIN c USING (source)",
    "sqrt_allocation": f"WITH {POOL}, {_HALF} SELECT category, available, taken FROM al",
    "sqrt_sample": f"WITH {POOL}, {_HALF} SELECT id, primary_category FROM (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY {hashed_sql('id')}, id) AS rn FROM pool WHERE label = 'harm') JOIN al ON primary_category = category WHERE rn <= taken",
    "group_kfold": f"""WITH RECURSIVE {PROMPTS}, g AS (SELECT source, count(*) AS n FROM prompts GROUP BY source), o AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, {hashed_sql('source')}, source) AS k FROM g),
m AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS source, 0::BIGINT AS fold, [0, 0, 0, 0]::BIGINT[] AS load
UNION ALL SELECT k, source, slot - 1, list_transform(load, lambda x, i: x + CASE WHEN i = slot THEN n ELSE 0 END) FROM (SELECT o.k, o.source, o.n, m.load, list_position(m.load, list_min(m.load)) AS slot FROM m JOIN o ON o.k = m.k + 1))
SELECT id, CAST(fold AS INTEGER) AS fold FROM prompts JOIN m USING (source)""",
    "template_bank": f"WITH {TEMPLATE_ROWS} SELECT CAST(template_id AS INTEGER) AS template_id, template, instr(template, '{{0}}') > 0 AS has_placeholder FROM tmpl",
    "code_contrast": f"WITH {_BANK} SELECT category, i - 1 AS harm_index, j - 1 AS safe_index, malicious[i] AS harm_text, benign_twin[j] AS safe_text FROM bank, range(1, 3) a(i), range(1, 3) b(j)",
    "code_paraphrase": f"WITH {_BANK}, u AS (SELECT category, 'malicious' AS kind, malicious AS t FROM bank UNION ALL SELECT category, 'benign_twin', benign_twin FROM bank) SELECT category, kind, 0 AS first, 1 AS second, t[1] AS first_text, t[2] AS second_text FROM u",
    "code_wrapped": f"""WITH {_BANK}, {TEMPLATE_ROWS}, z AS (SELECT category, i - 1 AS index, malicious[i] AS m, benign_twin[i] AS b FROM bank, range(1, 3) a(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY category, index ORDER BY {hashed_sql("concat_ws(':', concat_ws(':', category, CAST(index AS VARCHAR)), CAST(template_id AS VARCHAR))")}, template_id) AS rn FROM z, tmpl)
SELECT category, index, template_id, concat_ws(':', 'code_bank', category, 'malicious', CAST(index AS VARCHAR)) AS source_id, {WRAP.format("m")} AS harm_wrapped, {WRAP.format("b")} AS safe_wrapped FROM r WHERE rn <= 3""",
}
from ..sources.tables import uniform_sql  # noqa: E402

_BATCH = f"""{POOL}, hc AS (SELECT primary_category, count(*) AS n FROM pool WHERE label = 'harm' GROUP BY 1 HAVING count(*) >= 2),
st AS (SELECT step, primary_category, row_number() OVER (PARTITION BY step ORDER BY round(-ln({uniform_sql("concat_ws(':', CAST(step AS VARCHAR), primary_category)", "batch")} + 1e-12::DOUBLE) / sqrt(n::DOUBLE), 9), primary_category) AS rk FROM hc, range(0, 20) s(step)),
bt AS (SELECT * FROM (SELECT step, primary_category, id, source, lang, row_number() OVER (PARTITION BY step, primary_category ORDER BY {hashed_sql("concat_ws(':', CAST(step AS VARCHAR), CAST(id AS VARCHAR))", "row")}, id) AS rn FROM st JOIN pool USING (primary_category) WHERE rk <= 3 AND label = 'harm') WHERE rn <= 2)"""
ORACLE_SQL |= {
    "category_batches": f"WITH {_BATCH} SELECT CAST(step AS INTEGER) AS step, primary_category, id FROM bt",
    "positive_weights": f"WITH {_BATCH} SELECT CAST(a.step AS INTEGER) AS step, a.id AS a, b.id AS b, CASE WHEN a.source = b.source AND a.lang = b.lang THEN 1.0::DOUBLE WHEN a.primary_category = b.primary_category THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS weight FROM bt a JOIN bt b ON a.step = b.step AND a.id <> b.id",
}

QUERIES = {
    f.__name__: f for f in (
        pool_scan, pool_filters, pool_filter_counts, jailbreak_family, slice_tags, category_lists, label_normalize, any_label,
        text_length_profile, transcript_parse, head_tail_truncate, fingerprint, jsonl_roundtrip, dedup_first, label_conflicts, heldout_anti,
        eval_clean, eval_normalize, category_merge, contrast_pairs, safe_harm_random, wrap_variants, wrap_variants_v1, pair_unpivot,
        pairs_union, unique_texts_by_label, pairs_v1_manifest, pairs_v2_manifest, dataset_profile, style_cells, balanced_take,
        stratified_split, stratified_folds, pair_kfold, group_split, group_kfold, template_bank, code_contrast, code_paraphrase,
        code_wrapped, sqrt_allocation, sqrt_sample, category_batches, positive_weights
    )
}
