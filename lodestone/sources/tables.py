"""Tables of a data folder, and the shapes that the queries read them in.

A folder holds ``<name>.parquet`` per table. The views below give the synthetic tables the
shapes that the operators expect: labelled prompts, scored items, dialogs, run logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMPT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "prompt", "prompt_label", "violated_categories")])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None, kind: str | None = None) -> DataFrame:
    """Read csv, tsv, json lines (gzip too), json arrays or parquet; the suffix decides unless ``kind`` does.

    Kinds: csv, tsv, jsonl, json (one array or object per file), parquet.
    """
    plain = path.removesuffix(".gz")
    kind = kind or {"csv": "csv", "tsv": "tsv", "jsonl": "jsonl", "json": "json", "parquet": "parquet"}[plain.rsplit(".", 1)[-1]]
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"', inferSchema=schema is None)
    if kind in ("jsonl", "json"):
        return reader.json(path, multiLine=kind == "json")
    return reader.parquet(path)


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, prompt, prompt_label, violated_categories, lang, source, quality, toxic)."""
    d, l = load(spark, folder, "documents"), load(spark, folder, "labels")
    joined = d.join(l, "doc_id")
    caution = F.when(F.col("doc_id") % 3 == 0, F.lit("Needs Caution, ")).otherwise(F.lit(""))
    names = F.when(F.col("toxic") == 1, F.concat(caution, "source", F.lit(", "), "lang")).otherwise(F.lit(""))
    label = F.when(F.col("toxic") == 1, "unsafe").otherwise("safe")
    return joined.select(
        F.col("doc_id").alias("id"), F.col("text").alias("prompt"), label.alias("prompt_label"), names.alias("violated_categories"), "lang",
        "source", "quality", "toxic"
    )


PROMPTS = """prompts AS (SELECT d.doc_id AS id, d.text AS prompt, CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END AS prompt_label,
  CASE WHEN toxic = 1 THEN (CASE WHEN d.doc_id % 3 = 0 THEN 'Needs Caution, ' ELSE '' END) || d.source || ', ' || d.lang ELSE '' END AS violated_categories,
  d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"""


def uniform(key: F.Column, seed: int | str = 42) -> F.Column:
    """A number in [0, 1) from md5(seed:key); the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def uniform_sql(key: str, seed: int | str = 42) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '{seed}', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def hashed(key: F.Column, seed: int | str = 42) -> F.Column:
    """The md5 that orders rows at random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hashed_sql(key: str, seed: int | str = 42) -> str:
    return f"md5(concat_ws(':', '{seed}', CAST({key} AS VARCHAR)))"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(id, y, category, score, other_score, judge): two scores and a judge's decision for every vector."""
    e = load(spark, folder, "embeddings")
    x = lambda i: F.element_at("embedding", i).cast("double")
    y = (F.col("label") % 2).cast("int")
    wrong = uniform(F.col("vec_id"), "judge") < 0.1
    return e.select(
        F.col("vec_id").alias("id"), y.alias("y"), F.col("label").alias("category"),
        (F.round(x(1) + x(2) * 0.5 + y * 0.1, 3) + 0.0).alias("score"), (F.round(x(3) + y * 0.05, 3) + 0.0).alias("other_score"),
        F.when(wrong, 1 - y).otherwise(y).alias("judge")
    )


SCORED = f"""scored AS (SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS y, label AS category,
  round(embedding[1]::DOUBLE + embedding[2]::DOUBLE * 0.5::DOUBLE + (label % 2) * 0.1::DOUBLE, 3) + 0.0::DOUBLE AS score, round(embedding[3]::DOUBLE + (label % 2) * 0.05::DOUBLE, 3) + 0.0::DOUBLE AS other_score,
  CASE WHEN {uniform_sql("vec_id", "judge")} < 0.1 THEN 1 - label % 2 ELSE label % 2 END AS judge FROM embeddings)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(variant, seed, step, loss): events as the log of training runs.

    Steps count a run's events in time order. Events are counted by the hour first, so a task orders an hour of a run.
    """
    from pyspark.sql import Window

    e = load(spark, folder, "events").select(
        F.col("event_type").alias("variant"), (F.col("user_id") % 3).alias("seed"), "ts", "event_id", F.col("value").alias("loss")
    )
    e = e.withColumn("hour", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000))
    by = ["variant", "seed"]
    before = Window.partitionBy(*by).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = e.groupBy(*by, "hour").agg(F.count("*").alias("n")).select(
        *by, "hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    within = F.row_number().over(Window.partitionBy(*by, "hour").orderBy("ts", "event_id"))
    return e.join(hours, [*by, "hour"]).select(*by, (F.col("earlier") + within).cast("int").alias("step"), "loss")


RUNS = """runs AS (SELECT event_type AS variant, user_id % 3 AS seed, CAST(row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) AS INTEGER) AS step, value AS loss FROM events)"""


def dialogs(spark: SparkSession, folder: str) -> DataFrame:
    """(dialog_id, turns): the user's turns of every conversation, in order."""
    c = load(spark, folder, "conversations").where("role = 'user'")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy(F.col("conv_id").alias("dialog_id")).agg(turns.alias("turns"))


DIALOGS = "dialogs AS (SELECT conv_id AS dialog_id, list(text ORDER BY turn, text) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id)"
