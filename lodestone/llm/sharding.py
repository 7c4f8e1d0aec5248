"""Sharding by a k-d tree over metadata, split at distributed weighted medians."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_for, written

SHARDS = 16
#: Bins of a node's histogram in one pass; of each node only the bin that holds the quantile reaches the driver.
BINS = 1 << 14
#: Coordinates are cut into 2**CELL_BITS cells; the bits below hold a hash that breaks ties.
CELL_BITS, TIE_BITS = 22, 40
#: Rows of a shard that one task numbers.
SLOT_ROWS = 50_000
#: Of two dimensions as wide the first is cut; length comes last, since lengths set few large groups apart from many small ones.
DIMENSIONS = ("order", "source", "lang", "length")
#: A quantile is known well enough when its bin weighs this share of a leaf.
TOLERANCE = 1 / 2000
#: The groups are written again after so many levels of the tree, so their places are not found anew from the root.
LEVELS = 4


class _Node:
    """A node of the tree: its first leaf and number of leaves, weight, and bounds in every dimension."""

    def __init__(self, first: int, leaves: int, weight: int, box: dict[str, tuple[int, int]]):
        self.first, self.leaves, self.weight, self.box = first, leaves, weight, box
        self.dim = max(DIMENSIONS, key=lambda d: (box[d][1] - box[d][0], -DIMENSIONS.index(d)))
        self.lo, self.hi = box[self.dim]
        self.below, self.want = 0, weight * (leaves // 2) / leaves
        self.cut: int | None = None

    def narrow(self, step: int, at: int, weight: int, upto: int, tolerance: float) -> None:
        """The bin that holds the quantile: its number, its weight, and the weight up to its end."""
        lo = self.lo + at * step
        hi = min(self.hi, lo + step - 1)
        below = self.below + upto - weight
        if weight > tolerance and lo < hi:
            self.lo, self.hi, self.below = lo, hi, below
            return
        # the cut falls before or after this bin, whichever is nearer to the quantile
        after = below + weight - self.want <= self.want - below
        self.cut, self.below = (hi, below + weight) if after else (lo - 1, below)

    def halves(self) -> tuple[_Node, _Node]:
        lo, hi = self.box[self.dim]
        left, n = self.box | {self.dim: (lo, max(lo, self.cut))}, self.leaves // 2
        return _Node(self.first, n, self.below, left), _Node(
            self.first + n, self.leaves - n, self.weight - self.below, self.box | {self.dim: (min(hi, self.cut + 1), hi)}
        )


def _key() -> F.Column:
    return F.element_at(F.array(*[F.col(f"k_{d}") for d in DIMENSIONS]), F.col("dim"))


def _find_cuts(groups: DataFrame, nodes: list[_Node], tolerance: float) -> None:
    """Cut every node at the weighted quantile that its number of leaves asks for, along its widest dimension.

    Histograms zoom in: each pass sums the weights of at most BINS bins of every node that is still open, and the
    next pass bins the range of the bin that holds the quantile. It ends when the bin weighs at most ``tolerance``
    or holds one key.
    """
    while open_nodes := {n.first: n for n in nodes if n.cut is None}:
        steps = {k: max(1, -(-(n.hi - n.lo + 1) // BINS)) for k, n in open_nodes.items()}
        # a row per node, at most as many as leaves; as a table, so that every pass runs the same compiled code
        params = groups.sparkSession.createDataFrame(
            [(k, DIMENSIONS.index(n.dim) + 1, n.lo, n.hi, steps[k], float(n.want - n.below)) for k, n in open_nodes.items()],
            "node long, dim int, lo long, hi long, step long, want double"
        )
        binned = groups.join(F.broadcast(params), "node").withColumn("k", _key()).where("k BETWEEN lo AND hi")
        sums = binned.groupBy("node", "want", F.expr("(k - lo) div step").alias("bin")).agg(F.sum("bytes").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = sums.withColumn("upto", upto).where("upto >= want").groupBy("node").agg(F.min(F.struct("bin", "w", "upto")).alias("f"))
        hits = {r["node"]: r["f"] for r in found.collect()}
        for k, n in open_nodes.items():
            if k in hits:
                n.narrow(steps[k], hits[k]["bin"], hits[k]["w"], hits[k]["upto"], tolerance)
            else:  # an empty node
                n.cut = n.lo


def coordinates(rows: DataFrame) -> DataFrame:
    """(group, bytes, k_<dimension>...) of every group of rows with equal texts, from (group, size, doc_id, source, lang)."""
    lo_size, hi_size, lo_id, hi_id = rows.agg(F.min("size"), F.max("size"), F.min("doc_id"), F.max("doc_id")).first()
    code = lambda c: F.coalesce(F.crc32(F.min(c).cast("binary")).cast("double") / F.lit(2.0**32), F.lit(0.0))
    grouped = rows.groupBy("group").agg(
        F.sum("size").alias("bytes"), F.log(F.max("size").cast("double")).alias("length"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("order"), code("source").alias("source"), code("lang").alias("lang")
    )
    scaled = lambda c, lo, hi: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.lit(lo)) / F.lit(max(hi - lo, 1e-12))))
    unit = {
        "length": scaled("length", math.log(lo_size or 1), math.log(hi_size or 1)),
        "order": scaled("order", min(float(lo_id or 0), 0.0), float(hi_id or 0)), "source": F.col("source"), "lang": F.col("lang")
    }
    tie = F.conv(F.substring("group", 1, TIE_BITS // 4), 16, 10).cast("long")
    keys = [(F.shiftleft((unit[d] * F.lit(2**CELL_BITS - 1)).cast("long"), TIE_BITS) + tie).alias(f"k_{d}") for d in DIMENSIONS]
    return grouped.select("group", "bytes", *keys)


def base_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, size, text_crc32, group) of every row; ``group`` tells texts apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("group")
    )


def placed_groups(groups: DataFrame, leaves: int, tolerance: float = TOLERANCE) -> DataFrame:
    """(group, shard) from the tree over :func:`coordinates`. A group's node is told by the node's first leaf, which in the end is the shard."""
    ends = [f(F.col(f"k_{d}")) for d in DIMENSIONS for f in (F.min, F.max)]
    weight, *bounds = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), *ends).first()
    groups = groups.withColumn("node", F.lit(0).cast("long"))
    nodes = [_Node(0, leaves, weight, {d: (bounds[2 * i], bounds[2 * i + 1]) for i, d in enumerate(DIMENSIONS)})] if weight else []
    level = 0
    while cut := [n for n in nodes if n.leaves > 1]:
        _find_cuts(groups, cut, weight / leaves * tolerance)
        split = groups.sparkSession.createDataFrame(
            [(n.first, DIMENSIONS.index(n.dim) + 1, n.cut, n.leaves // 2) for n in cut], "node long, dim int, cut long, half long"
        )
        moved = F.col("node") + F.when(_key() > F.col("cut"), F.col("half")).otherwise(F.lit(0))
        groups = groups.join(F.broadcast(split), "node", "left").select(
            "group", "bytes", *[f"k_{d}" for d in DIMENSIONS], moved.alias("node")
        )
        nodes = [x for n in nodes for x in (n.halves() if n.leaves > 1 else (n,))]
        level += 1
        if level % LEVELS == 0 and any(n.leaves > 1 for n in nodes):
            groups = written(groups, "shard-groups")
    return groups.select("group", F.col("node").cast("int").alias("shard"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near equal bytes from a k-d tree.

    ``size`` is the UTF-8 length of the text plus 1. Equal texts are one group and stay in one
    shard; a null text is grouped with the empty text. A group has its bytes as weight and four
    coordinates scaled to 0..1 over all groups: smallest doc_id, source, language (a hash of the smallest
    value; null is 0) and log length. From the root, a node is cut along the widest dimension of its
    bounds at the weighted median (the quantile that its number of leaves asks for), until there are
    ``shards`` leaves, or leaves of ``target_bytes``. Cells that tie are cut by a hash of the text, so hot
    values of a dimension split. Of histograms only one bin a node reaches the driver.

    Slots number the rows of a shard from 0 without gaps: rows are counted by (shard, hash
    bucket), the counts are accumulated, and each bucket is numbered by doc_id in its own task.
    Null doc_ids stand last in their bucket. Repeated rows keep slots of their own. An
    empty table gives an empty result; columns other than doc_id, text, source and lang are ignored.
    """
    base = written(base_rows(docs), "shard-rows")
    total, count = base.agg(F.sum("size"), F.count("*")).first()
    leaves = shards or max(1, partitions_for(total or 0, target_bytes or 1))
    placed = placed_groups(written(coordinates(base), "shard-groups"), leaves, tolerance)
    buckets = partitions_for(count, SLOT_ROWS * max(1, leaves), 4)
    rows = base.join(placed, "group").select(
        "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).alias("bucket")
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return rows.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.row_number().over(place) - 1).cast("long").alias("slot")
    )


def op7_kdtree(spark, sf_dir: str) -> DataFrame:
    x = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=SHARDS)
    return x.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
