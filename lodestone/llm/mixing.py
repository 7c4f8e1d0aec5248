"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Rows that one sorted bucket of a source should hold.
BUCKET_ROWS = 20_000

BLANK = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def word_count(text: str = "text") -> F.Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; 0 for null or blank texts."""
    return F.expr(
        f"CASE WHEN {text} IS NULL OR btrim({text}, {BLANK}) = '' THEN 0L ELSE CAST(size(split(btrim({text}, {BLANK}), '[\\\\x20\\\\x09-\\\\x0D]+')) AS BIGINT) END"
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    A target is ``least(most * size, weight * level)``. The level is found in closed form:
    with sources in order of cap / weight, it is the first quotient of what is left to
    share and the weights left that does not exceed the cap of its own source. One row per
    distinct source passes through the unpartitioned windows, never one per document.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_code) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.select(
        "source", "source_size", rank.alias("rank"), weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")
    )
    order = Window.orderBy((F.col("cap") / F.col("w")), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    t = t.select(
        "*", F.sum("source_size").over(every).alias("all_size"), F.sum("w").over(every).alias("all_w"), before("cap").alias("cap_before"),
        before("w").alias("w_before")
    )
    t = t.withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    at = F.col("cap") / F.col("w")
    t = t.withColumn(
        "water", F.min(F.when(F.col("level") <= at, F.struct(at.alias("at"), F.col("rank"), F.col("level")))).over(every).getField("level")
    )
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("water"), F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame, seed: int = 42, size: F.Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    most: float = MOST_EPOCHS
) -> DataFrame:
    """Words that a mix takes of each document: (doc_id, source, size, source_size, target, taken).

    Each document gets the key md5(seed:doc_id). Within a source documents stand in key
    order; whole epochs are taken while the target exceeds the source, and the last, partial
    epoch is cut at the exact budget, so the words taken of a source are its target rounded
    down and the document at the cut is taken in part. Keys are uniform, so equal key
    prefixes are range partitions: a bucket of a source is summed, bucket sums are
    accumulated, and only a bucket is ever sorted in one task, however large a source is.

    Null texts and blank texts have size 0 and take 0; a null source is a source of its own
    and stands last; null doc_ids share one key. Repeated rows are documents of their own,
    in the order of their sizes. An empty table gives an empty result. Further columns of the
    input are ignored.
    """
    base = written(
        docs.select("doc_id", "source", (word_count() if size is None else size).alias("size")).withColumn(
            "key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
        ),
        "mix"
    )
    rows = base.count()
    width = 0
    while rows > BUCKET_ROWS * 16**width and width < 12:
        width += 1
    base = base.withColumn("bucket", F.substring("key", 1, width) if width else F.lit(""))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_source = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)).alias("offset"))
    cuts = sums.alias("b").join(per_source.alias("t"), F.expr("b.source <=> t.source")).select(
        "b.source", "b.bucket", "offset", "source_size", "target"
    )
    x = base.alias("d").join(cuts.alias("c"), F.expr("d.source <=> c.source AND d.bucket = c.bucket")).select(
        "d.doc_id", "d.source", "d.size", "d.key", "d.bucket", "c.offset", "c.source_size", "c.target"
    )
    run = Window.partitionBy("source", "bucket").orderBy(
        "key", F.col("doc_id").asc_nulls_last(), "size"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("start", F.col("offset") + F.sum("size").over(run) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    x = x.withColumn("epochs", epochs.cast("long"))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    extra = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest.cast("long") - F.col("start")))
    return x.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken")
    )


#: The contract's rows in DuckDB SQL over a table with doc_id, text and source.
def mix_sql(table: str = "documents", seed: int = 42) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5(concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM {table}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / w AS ratio, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lev
      FROM w WINDOW before AS (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT lev AS water FROM l WHERE lev <= ratio ORDER BY ratio, rnk LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT water FROM k), cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - d.size AS start,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, floor(target - epochs * source_size) - start)) AS BIGINT) AS taken FROM p"""


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
