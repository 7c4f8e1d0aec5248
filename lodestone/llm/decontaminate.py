"""Benchmark decontamination with SimHash fingerprints of item-sized windows; DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits; shingles have WORDS words (all of
an item's words if it has fewer). A window of an item's size starts at every word, and before the text
and behind its end it is cut short. A window as similar as asked shares at least a known number
of shingles with the item, so windows with fewer places whose shingle any item of their size has
are left out; all others are fingerprinted, as running sums of the shingles' bits, and looked up in a
multi-index of the items' fingerprints: the 64 bits are cut into BLOCKS blocks, and two fingerprints that
differ in at most 2 * BLOCKS - 1 bits differ in at most one bit of some block, so items are indexed under
every block value and its one-bit neighbours and all of them within the radius are found. Texts and
items so found are verified by the exact weighted Jaccard similarity of their shingles, weighted by their counts, in
all windows, again as running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORDS = 5
SIMILARITY = 0.8
#: 64 bits in blocks of 7 and 6; at similarity 0.8 about 10 bits differ, with a deviation of 3.
BLOCKS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
RADIUS = 2 * len(BLOCKS) - 1
#: Shingles of a benchmark that may be broadcast (about 32 bytes each); beyond, the joins shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Keys of texts that may be broadcast (about 60 bytes each, with their places) to find the texts again.
BROADCAST_TEXTS = 500_000
#: Three bits are counted in one long, in fields of this many bits.
FIELD = 21

_CUT = "[^\\\\p{L}\\\\p{N}]+"


def _words(text: str) -> F.Column:
    return F.expr(f"array_remove(split(lower({text}), '{_CUT}'), '')")


def _shingle(words: str, at: str, k: int) -> str:
    return f"xxhash64({', '.join(f'get({words}, {at} + {j})' for j in range(k))})"


def _any_shingle(words: str, at: str, k: str) -> str:
    return f"CASE {k} {' '.join(f'WHEN {i} THEN {_shingle(words, at, i)}' for i in range(1, WORDS + 1))} END"


def _counted(shingle: str) -> list[F.Column]:
    """The 64 bits of a shingle's hash, three to a long."""
    terms = [
        [
            f"shiftleft(shiftrightunsigned({shingle}, {b}) & 1L, {FIELD * j})" for j, b in enumerate(range(i, min(i + 3, 64)))
        ] for i in range(0, 64, 3)
    ]
    return [F.expr(" + ".join(t)).alias(f"v{i}") for i, t in enumerate(terms)]


_SUMS = [f"v{i}" for i in range(22)]


def _fingerprint(total: str) -> F.Column:
    """SimHash: bit j is set if more shingles, counted with repeats, have it set than not."""
    bits = [
        f"CASE WHEN 2 * (shiftrightunsigned(v{j // 3}, {FIELD * (j % 3)}) & {(1 << FIELD) - 1}L) > {total} THEN shiftleft(1L, {j}) ELSE 0L END" for j in range(64)
    ]
    return F.expr(" | ".join(bits))


def _blocks(fingerprint: str, near: bool) -> F.Column:
    """Array of (block, value) keys of a fingerprint, with the one-bit neighbours of each if ``near``."""
    keys, shift = [], 0
    for b, width in enumerate(BLOCKS):
        value = f"CAST(shiftrightunsigned({fingerprint}, {shift}) & {(1 << width) - 1}L AS INT)"
        flips = [0, *(1 << j for j in range(width))] if near else [0]
        keys += [f"struct({b} AS block, ({value} ^ {f}) AS value)" for f in flips]
        shift += width
    return F.expr(f"array({', '.join(keys)})")


def text_key(text: F.Column) -> F.Column:
    """A 128-bit digest that tells texts apart; null for a null text."""
    return F.md5(text.cast("binary"))


def _running(events: DataFrame, by: list[str], sums: list[str], keep: list | None = None) -> DataFrame:
    """Sums of all events at or before each place ``s``, and the next place with events."""
    once = events.groupBy(*by, "s").agg(*[F.sum(c).alias(c) for c in sums], *(keep or []))
    order = Window.partitionBy(*by).orderBy("s")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = [c for c in once.columns if c not in sums]
    return once.select(*others, *[F.sum(c).over(until).alias(c) for c in sums], F.lead("s").over(order).alias("following"))


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, distance, start) of every document and item that it holds.

    ``similarity`` is the best of all windows of the item's size in the document, ``start`` the first word of
    the first such window, ``distance`` its Hamming distance from the item. Every position of every text
    is compared with the benchmark's shingles in one pass without a shuffle while the benchmark has at
    most BROADCAST_SHINGLES; only texts with enough of them go on, and copies of a text go on once.
    Items with fewer than WORDS words match as a whole.

    Null or blank texts and items hold nothing. Rows are told apart by their texts: documents with a null
    doc_id are reported under null, and repeated rows of a doc_id or an item_id are reported once, with the best
    window of all their texts. Empty tables give an empty result; further columns are ignored.
    """
    leaks = written(leaking_texts(docs, items, similarity), "leaks")
    named = docs.select("doc_id", text_key(F.col("text")).alias("text_key"))
    found = named.join(_sized(leaks, leaks.count()), "text_key")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "distance"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.distance").alias("distance"), F.col("b.start").alias("start")
    )


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TEXTS else df


def _shingled(items: DataFrame) -> DataFrame:
    """(item_id, item, size, k, place, shingle) of every shingle of every item; ``item`` tells repeated item_ids apart."""
    words = items.select("item_id", F.xxhash64("text").alias("item"), _words("text").alias("iw")).where("size(iw) > 0")
    at = words.select(
        "item_id", "item", "iw", F.expr("size(iw)").alias("size"), F.least(F.expr("size(iw)"), F.lit(WORDS)).alias("k")
    ).distinct()
    at = at.select("*", F.explode(F.expr("sequence(0, size - k)")).alias("place"))
    return at.select("item_id", "item", "size", "k", "place", F.expr(_any_shingle("iw", "place", "k")).alias("shingle"))


def leaking_texts(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(text_key, item_id, similarity, distance, start): the best window of every text and item that it holds."""
    item = written(_shingled(items), "leaks-items")
    places = item.select("k", "shingle", "size").distinct()
    total, short, longest = places.agg(F.count("*"), F.array_sort(F.collect_set("k")), F.coalesce(F.max("size"), F.lit(0))).first()
    if longest >= 1 << (FIELD - 1):
        raise ValueError(f"an item of {longest} words is longer than the counters of its window's bits")
    hint = F.broadcast if total <= BROADCAST_SHINGLES else (lambda x: x)

    # places of texts whose shingle some item has
    words = docs.select(text_key(F.col("text")).alias("text_key"), _words("text").alias("w"))
    seeds = None
    for k in short or [WORDS]:
        keys = places.where(f"k = {k}").select("shingle").distinct()
        at = words.where(f"size(w) >= {k}").select("text_key", "w", F.explode(F.expr(f"sequence(0, size(w) - {k})")).alias("at"))
        hashed = at.select(
            "text_key", F.lit(k).alias("k"), F.expr(f"size(w) - {k - 1}").alias("n"), "at", F.expr(_shingle("w", "at", k)).alias("shingle")
        )
        met = hashed.join(hint(keys), "shingle")
        seeds = met if seeds is None else seeds.unionByName(met)
    seeds = written(seeds.groupBy("text_key", "k", "n", "at", "shingle").agg(F.lit(1).alias("one")).drop("one"), "leaks-seeds")

    # windows with enough such places, where m shingles are an item's and w the window's
    m, w = F.expr("size - k + 1"), F.expr("least(start + m, n) - greatest(start, 0)")
    sized = seeds.join(hint(places), ["k", "shingle"]).select("text_key", "size", "k", "n", m.alias("m"), "at")
    both = F.explode(F.expr("array(struct(at - m + 1 AS s, 1 AS d), struct(at + 1 AS s, -1 AS d))")).alias("e")
    events = sized.select("text_key", "size", "k", "n", "m", both).select("text_key", "size", "k", "n", "m", "e.*")
    runs = _running(events, ["text_key", "size", "k", "n", "m"], ["d"]).where(f"d >= {similarity} * m - 1e-6 AND d > 0")
    starts = runs.select("text_key", "size", "k", "n", "m", "d", F.explode(F.expr("sequence(s, following - 1)")).alias("start"))
    starts = written(
        starts.select("*", w.alias("w")).where(f"d * {1 + similarity} >= {similarity} * (m + w) - 1e-6").drop("d"), "leaks-starts"
    )

    # their texts again, and the shingles that lie in them
    order = Window.partitionBy("text_key", "size").orderBy("start")
    gap = F.coalesce((F.col("start") - F.lag("start").over(order) > F.col("m")).cast("int"), F.lit(0))
    ranges = starts.select("*", gap.alias("gap")).select("*", F.sum("gap").over(order).alias("island")).groupBy("text_key", "size", "k", "n", "m", "island").agg(
        F.min("start").alias("lo"), F.max("start").alias("hi")
    )
    wanted = written(
        ranges.groupBy("text_key").agg(F.collect_list(F.struct("size", "k", "n", "m", "island", "lo", "hi")).alias("ranges")), "leaks-texts"
    )
    texts = docs.select(text_key(F.col("text")).alias("text_key"), "text").join(
        _sized(wanted.select("text_key"), wanted.count()), "text_key"
    )
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text")).join(wanted, "text_key")
    split = texts.select(
        "text_key", "ranges", _words("text").alias("w")
    ).select("text_key", "w", F.explode("ranges").alias("r")).select("text_key", "w", "r.*")
    inside = split.select(
        "text_key", "size", "island", "k", "m", "w", F.explode(F.expr("sequence(greatest(lo, 0), least(hi + m, n) - 1)")).alias("at")
    )
    hashes = inside.select("text_key", "size", "island", "m", "at", F.expr(_any_shingle("w", "at", "k")).alias("shingle"))

    # fingerprints of the windows, and the items near them
    values = hashes.select("text_key", "size", "island", "m", "at", *_counted("shingle"))
    signed = [
        values.select("text_key", "size", "island", F.expr(place).alias("s"), *[F.expr(f"{sign}{v}").alias(v) for v in _SUMS]) for place,
        sign in (("at - m + 1", ""), ("at + 1", "-"))
    ]
    sums = _running(signed[0].union(signed[1]), ["text_key", "size", "island"], _SUMS).withColumnRenamed("s", "start")
    windows = sums.join(starts.select("text_key", "size", "m", "w", "start"), ["text_key", "size", "start"])
    windows = written(windows.select("text_key", "size", "m", "w", "start", _fingerprint("w").alias("fp")), "leaks-windows")
    near = near_items(windows, item, hint)
    pairs = written(near.select("text_key", "item_id", "item", "size").distinct(), "leaks-pairs")

    # a shingle's occurrence in a window is shared unless the window holds as many earlier ones as the item has
    weights = item.groupBy("item_id", "item", "size", "k", "shingle").agg(F.count("*").cast("int").alias("c"))
    of = ["text_key", "item_id", "item"]
    have = seeds.join(F.broadcast(weights) if total <= BROADCAST_SHINGLES else weights, ["k", "shingle"]).join(pairs, [*of, "size"])
    have = have.select(*of, "shingle", "at", "c", m.alias("m"))
    ranked = have.withColumn("r", F.row_number().over(Window.partitionBy(*of, "shingle").orderBy("at")))
    earlier = ranked.select(*of, "shingle", (F.col("r") + F.col("c")).alias("r"), F.col("at").alias("before"))
    begins = ranked.join(earlier, [*of, "shingle", "r"], "left").select(
        *of, F.expr("greatest(coalesce(before + 1, at - m + 1), at - m + 1)").alias("s"), F.col("at").alias("at")
    )
    gains = begins.select(
        *of, F.explode(F.expr("array(struct(s AS s, 1 AS shared), struct(at + 1 AS s, -1 AS shared))")).alias("e")
    ).select(*of, "e.*")
    none = {"w": "int", "m": "int", "fp": "long"}
    tried = windows.join(pairs, ["text_key", "size"]).select(*of, F.col("start").alias("s"), F.lit(0).alias("shared"), "w", "m", "fp")
    events = gains.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).unionByName(tried)
    scored = _running(events, of, ["shared"], [F.max(c).alias(c) for c in none]).where("w IS NOT NULL")
    scored = scored.withColumn(
        "similarity", F.col("shared") / (F.col("w") + F.col("m") - F.col("shared"))
    ).where(F.col("similarity") >= similarity)
    best = scored.groupBy(*of).agg(
        F.min(F.struct((-F.col("similarity")).alias("x"), F.greatest("s", F.lit(0)).alias("start"), "s", "fp")).alias("b")
    )
    prints = item_prints(item)
    distance = F.bit_count(F.col("b.fp").bitwiseXOR(F.col("ifp"))).cast("int")
    return best.join(F.broadcast(prints) if total <= BROADCAST_SHINGLES else prints, ["item_id", "item"]).select(
        "text_key", "item_id", (-F.col("b.x")).alias("similarity"), distance.alias("distance"), F.col("b.start").cast("int").alias("start")
    )


def item_prints(item: DataFrame) -> DataFrame:
    """(item_id, item, size, ifp): the fingerprint of every item."""
    sums = item.select("item_id", "item", "size", *_counted("shingle")).groupBy("item_id", "item", "size").agg(
        *[F.sum(v).alias(v) for v in _SUMS], F.count("*").alias("m")
    )
    return sums.select("item_id", "item", "size", _fingerprint("m").alias("ifp"))


def near_items(windows: DataFrame, item: DataFrame, hint=F.broadcast) -> DataFrame:
    """Windows (size, fp, ...) with every item of their size whose fingerprint is within RADIUS."""
    keyed = windows.select("*", F.explode(_blocks("fp", False)).alias("key"))
    index = item_prints(item).select("item_id", "item", "size", "ifp", F.explode(_blocks("ifp", True)).alias("key"))
    return keyed.join(hint(index), ["size", "key"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)


#: All windows that share a shingle and their similarities in DuckDB SQL (items of at least five words), for small tables.
LEAKS_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ip AS (SELECT item_id, len(w) AS size, w, unnest(range(1, len(w) - 3)) AS p FROM i),
ic AS (SELECT item_id, size, array_to_string(w[p:p+4], ' ') AS s, count(*) AS c FROM ip GROUP BY ALL),
dp AS (SELECT doc_id, w, len(w) - 4 AS n, unnest(range(1, len(w) - 3)) AS p FROM d),
ds AS (SELECT doc_id, w, n, p, array_to_string(w[p:p+4], ' ') AS s FROM dp),
seed AS (SELECT DISTINCT doc_id, w, n, size, p FROM ds JOIN (SELECT DISTINCT size, s FROM ic) USING (s)),
win AS (SELECT DISTINCT doc_id, w, n, size, unnest(range(p - size + 5, p + 1)) AS b FROM seed),
tok AS (SELECT doc_id, w, n, size, b, unnest(range(greatest(b, 1), least(b + size - 5, n) + 1)) AS p FROM win),
cnt AS (SELECT doc_id, w, n, size, b, array_to_string(w[p:p+4], ' ') AS s, count(*) AS c FROM tok GROUP BY ALL),
sc AS (SELECT doc_id, w, item_id, size, b, sum(least(cnt.c, ic.c)) AS shared, any_value(least(b + size - 5, n) - greatest(b, 1) + 1) AS own FROM cnt JOIN ic USING (size, s) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, greatest(b, 1) - 1 AS start, shared / (own + size - 4 - shared) AS similarity FROM sc)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(start, (-similarity, start)) AS INTEGER) AS start FROM sim WHERE similarity >= 0.8 GROUP BY ALL"""


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, items).drop("distance")
