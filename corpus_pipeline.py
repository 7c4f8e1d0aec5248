"""From raw documents to shards: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Ids of dropped documents are broadcast while there are at most BROADCAST_IDS of
them, so texts are not shuffled; beyond that the joins shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, mixing, sharding, toxicity
from lodestone.llm.shared import freed, trimmed, written

BROADCAST_IDS = 2_000_000
SHARDS = 16


def _sized(small: DataFrame, name: str) -> DataFrame:
    """The table with a broadcast hint if it has few rows."""
    table = written(small, name)
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _stage(f: Callable) -> Callable:
    """A stage that first lets the driver forget the plans and tables of the stages before."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        freed(spark)
        return f(spark, docs, sf_dir)

    return run


def _ids_tell_rows_apart(docs: DataFrame) -> bool:
    rows, known, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    return rows == known == distinct


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score reaches the threshold of their language.

    The classifier learns from all labelled documents of the input (a bounded number of each label).
    Every row is judged by itself; no column of the input is replaced.
    """
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    trimmed()  # what the training took would stay with the driver
    return toxicity.rate(docs, net, ("score ", "threshold ", "toxic ")).where("NOT `toxic `").select(*docs.columns)


@_stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates.

    Groups are connected by five-word shingles and a Jaccard similarity of 0.8. A null doc_id stands
    last. Rows that share a doc_id only are documents of their own; of rows that share a doc_id and a text,
    null doc_ids included, one stays, and of one doc_id in a group the text with the smallest digest.
    Rows without words link with nothing and all stay.
    """
    if _ids_tell_rows_apart(docs):
        groups = written(jaccard.join_groups(docs, words=5, percent=80), "pipeline-groups")
        gone = groups.where("doc_id <> component_id").select("doc_id")
        return docs.join(_sized(gone, "pipeline-copies"), "doc_id", "left_anti").select(*docs.columns)
    key = decontaminate.text_key(F.col("text"))
    named = docs.select(F.col("doc_id").alias("id"), key.alias("key")).groupBy("id", "key").agg(F.count("*").alias("rows"))
    nodes = written(named.select("*", F.monotonically_increasing_id().alias("node")), "pipeline-nodes")
    few = _sized(nodes.select("id", "key", "node"), "pipeline-nodes")
    keyed = docs.withColumn("key ", key).alias("d").join(
        few.alias("n"), F.expr("d.doc_id <=> n.id AND d.`key ` <=> n.key")
    ).select("d.*", F.col("n.node").alias("node "))
    keyed = written(keyed.drop("key "), "pipeline-keyed")
    groups = written(
        jaccard.join_groups(keyed.select(F.col("node ").alias("doc_id"), "text"), words=5, percent=80).where("n_shingles > 0").distinct(),
        "pipeline-groups"
    )
    members = groups.join(nodes, F.col("doc_id") == F.col("node")).select(
        "component_id", "node", "rows", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("order")
    )
    first = members.groupBy("component_id").agg(F.min_by("node", "order").alias("first"))
    marked = written(members.join(first, "component_id"), "pipeline-members")
    kept = keyed.join(_sized(marked.where("node <> first").select(F.col("node").alias("node ")), "pipeline-copies"), "node ", "left_anti")
    # rows of one doc_id and text: only these are shuffled
    repeated = _sized(marked.where("node = first AND rows > 1").select(F.col("node").alias("node ")), "pipeline-repeated")
    once = kept.join(repeated, "node ", "left_semi").dropDuplicates(["node "])
    return kept.join(repeated, "node ", "left_anti").unionByName(once).select(*docs.columns)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark, told by their texts, so rows without a doc_id are dropped too."""
    leaks = decontaminate.leaking_texts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = _sized(leaks.select(F.col("text_key").alias("text_key ")).distinct(), "pipeline-leaks")
    return docs.withColumn("text_key ", decontaminate.text_key(F.col("text"))).join(gone, "text_key ", "left_anti").select(*docs.columns)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources' words meet their targets.

    A document comes once for every whole epoch, and once more if at least half of it lies
    before the cut of the last epoch; so a source misses its target by half a document at most.
    Every row counts by itself: where doc_ids are null or repeat, rows are numbered for the mix.
    Documents without words take nothing of a target and come once.
    """
    row = "doc_id"
    if not _ids_tell_rows_apart(docs):
        row, docs = "row ", written(docs.withColumn("row ", F.monotonically_increasing_id()), "pipeline-rows")
    taken = mixing.mix(docs.select(F.col(row).alias("doc_id"), "source", "text"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    chosen = taken.select(F.col("doc_id").alias(row), copies.alias("copies ")).where("`copies ` > 0")
    joined = docs.join(_sized(chosen, "pipeline-mix"), row)
    return joined.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("copies "))).alias("copy ")
    ).select(*[c for c in docs.columns if c != "row "])


@_stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of the mix."""
    return sharding.kd_shards(docs, shards=SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
