"""Near-duplicate vectors by tile products of int8 quantised vectors with rigorous error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, forest, ship, written

THRESHOLD = 0.95
#: Vectors of a group; two groups meet in one task, so a task holds twice as many.
GROUP_VECTORS = 16_384
#: Groups at least, so that small tables still spread over a cluster (pairs of groups are tasks).
LEAST_GROUPS = 6
#: Side of a tile in a task, and vectors in a packed chunk.
TILE, CHUNK = 2048, 2048
#: Dimensions for which sums of products of int8 values stay exact in single precision.
EXACT = (1 << 24) // (127 * 127)
#: Slack for rounding in the evaluation of bounds, which are compared in single precision.
ROUNDING = 1e-5
#: Slack for rounding in double precision, of sums and of what is taken for the exact cosine.
FINE = 1e-12
#: What a chunk holds: ids, numbers of equal vectors, codes, finer codes, and scale, error, finer scale and error of each vector.
PACKED = ("ids", "copies", "codes", "finer", "bounds")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, error norms) of unit vectors: |x - scale * code| <= error."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None])
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-12
    return codes.astype(np.int8), scale, error


def possible(
    qa: np.ndarray, sa: np.ndarray, ea: np.ndarray, qb: np.ndarray, sb: np.ndarray, eb: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile whose cosine may reach the threshold.

    With x = s*q + e the product of two unit vectors differs from s*s'*(q.q') by at most
    |e|*(1 + |e'|) + |e'|. The integer products are exact in single precision (in slices of EXACT
    dimensions). A first comparison uses the tile's largest error on one side; its few pairs
    are compared by their own bounds.
    """
    dims = qa.shape[1]
    dots = np.zeros((len(qa), len(qb)), np.float32 if dims <= EXACT else np.float64)
    for d in range(0, dims, EXACT):
        dots += qa[:, d : d + EXACT].astype(np.float32) @ qb[:, d : d + EXACT].astype(np.float32).T
    dots *= sb.astype(np.float32)
    bound = (threshold - ROUNDING - ea * (1 + eb.max()) - eb.max()) / sa
    i, j = np.nonzero(dots >= (bound - np.abs(bound) * 1e-6).astype(np.float32)[:, None])
    ok = dots[i, j] * sa[i] + ea[i] * (1 + eb[j]) + eb[j] >= threshold - ROUNDING
    return i[ok], j[ok]


def _chunks(groups: int):
    """Packed chunks of quantised vectors, one copy for every pair of groups that the vectors' group is in.

    A vector goes as two layers of codes, two bytes a dimension: its int8 codes and those of what they leave.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, group = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            size = np.diff(batch.column(2).offsets.to_numpy())
            start = np.cumsum(size) - size
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for g, dims in sorted(set(zip(group.tolist(), size.tolist(), strict=True))):
                mine = np.flatnonzero((group == g) & (size == dims))
                for a in range(0, len(mine), CHUNK):
                    part = mine[a : a + CHUNK]
                    pairs = [min(g, o) * groups + max(g, o) for o in range(groups)]
                    raw = flat[start[part][:, None] + np.arange(dims)]
                    unit = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
                    codes, scale, error = quantise(unit)
                    finer, step, rest = quantise(unit - codes * scale[:, None])
                    blobs = [ids[part].astype(np.int64), copies[part].astype(np.int64), codes, finer, np.stack([scale, error, step, rest])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pairs, pa.int64()), pa.array([g] * groups, pa.int32()), pa.array([dims] * groups, pa.int32())] + [pa.array([x.tobytes()] * groups, pa.binary()) for x in blobs],
                        names=["pair", "side", "dims", *PACKED],
                    )

    return pack


class _Side:
    """The vectors of one group and length: codes with their bounds, and the nearer form that both layers give."""

    def __init__(self, chunks: list[tuple[bytes, ...]], dims: int):
        read = lambda k, t: np.concatenate([np.frombuffer(c[k], t) for c in chunks])
        self.ids, self.copies = read(0, np.int64), read(1, np.int64)
        self.codes, finer = (read(k, np.int8).reshape(-1, dims) for k in (2, 3))
        self.scale, self.error, step, self.rest = np.concatenate([np.frombuffer(c[4], np.float64).reshape(4, -1) for c in chunks], axis=1)
        self.near = self.codes * self.scale[:, None] + finer * step[:, None]
        self.linked = np.zeros(len(self.ids), np.int64)


def _compare(groups: int, threshold: float, tile: int):
    """All pairs of two groups: linked copies per vector, a spanning forest of the links, and the pairs that the bounds leave open."""

    def compare(table: pa.Table) -> pa.Table:
        first, second = divmod(table.column("pair")[0].as_py(), groups)
        chunks: dict[tuple[int, int], list] = {}
        for side, dims, *blobs in sorted(zip(*(table.column(c).to_pylist() for c in ("side", "dims", *PACKED)), strict=True)):
            chunks.setdefault((side, dims), []).append(blobs)
        node, count, open_a, open_b = [], [], [], []
        link = (np.empty(0, np.int64), np.empty(0, np.int64))
        for dims in sorted({d for _, d in chunks}):  # vectors of different length have no cosine
            packed = {side: _Side(chunks[side, dims], dims) for side in {first, second} if (side, dims) in chunks}
            if first not in packed or second not in packed:
                continue
            a, b = packed[first], packed[second]
            for i0 in range(0, len(a.ids), tile):
                for j0 in range(i0 if first == second else 0, len(b.ids), tile):
                    ra, rb = slice(i0, i0 + tile), slice(j0, j0 + tile)
                    i, j = possible(a.codes[ra], a.scale[ra], a.error[ra], b.codes[rb], b.scale[rb], b.error[rb], threshold)
                    if first == second and i0 == j0:
                        i, j = i[i < j], j[i < j]
                    i, j = i + i0, j + j0
                    dot = np.empty(len(i))
                    for s in range(0, len(i), 1 << 16):  # a bounded number at once
                        k = slice(s, s + (1 << 16))
                        dot[k] = np.einsum("ij,ij->i", a.near[i[k]], b.near[j[k]])
                    slack = a.rest[i] * (1 + b.rest[j]) + b.rest[j] + FINE
                    sure, unsure = dot - slack >= threshold, np.abs(dot - threshold) < slack
                    open_a.append(a.ids[i[unsure]])
                    open_b.append(b.ids[j[unsure]])
                    i, j = i[sure], j[sure]
                    np.add.at(a.linked, i, b.copies[j])
                    np.add.at(b.linked, j, a.copies[i])
                    if len(i):
                        link = forest(np.concatenate([link[0], a.ids[i]]), np.concatenate([link[1], b.ids[j]]))
            for side in packed.values():
                hit = side.linked > 0
                node.append(side.ids[hit])
                count.append(side.linked[hit])
        columns = [
            (np.concatenate([np.empty(0, np.int64), *x]), np.concatenate([np.empty(0, np.int64), *y])) for x,
            y in ((node, count), ([link[0]], [link[1]]), (open_a, open_b))
        ]
        rows = [len(x) for x, _ in columns]
        out = {}
        for k, names in enumerate((("node", "n"), ("u", "v"), ("a", "b"))):
            for name, x in zip(names, columns[k], strict=True):
                out[name] = pa.concat_arrays(
                    [pa.nulls(sum(rows[:k]), pa.int64()), pa.array(x, pa.int64()), pa.nulls(sum(rows[k + 1 :]), pa.int64())]
                )
        return pa.table(out)

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Two vectors link when their cosine, in double precision, reaches the threshold. Equal
    vectors are compared once: they are one class with the number of its rows, whose members
    all link. Classes are dealt to groups by hash; every pair of groups is a task that holds two groups'
    codes and multiplies their int8 codes tile by tile. Pairs that the error bounds admit are computed from a
    second layer of codes, whose bounds decide all but pairs very near the threshold; for those alone the vectors
    are fetched and compared in double precision. A task returns counts and a spanning forest, at most a row
    a vector, so dense groups of near copies cost no pairs between tasks.

    Null vectors, zero vectors and vectors with a null or non-finite component link with
    nothing; neither do vectors of different lengths. Rows with the same vec_id count as rows of
    their own for n_links and share the id's component. Null vec_ids are returned unlinked. An empty
    table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # scaled by a power of two, so that squares neither overflow nor vanish; cosines don't change
    top = F.array_max(F.transform("embedding", F.abs))
    scale = F.pow(F.lit(2.0), -F.floor(F.log2(top)))
    rows = rows.withColumn("class", F.when(usable, F.transform("embedding", lambda x: x * scale)))
    base = written(
        rows.select(
            "vec_id", F.col("class").alias("vector"),
            F.when(
                usable, F.sha2(F.to_binary(F.array_join(F.transform("class", lambda x: x.cast("string")), ","), F.lit("utf-8")), 256)
            ).alias("key")
        ),
        "vectors"
    )
    classes = written(
        base.where("key IS NOT NULL").groupBy("key").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")
        ),
        "vector-classes"
    )
    n = classes.count()
    groups = max(LEAST_GROUPS, -(-n // GROUP_VECTORS))
    dealt = classes.select("rep", "copies", "vector", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group"))
    chunks = dealt.mapInArrow(_chunks(groups), "pair long, side int, dims int, " + ", ".join(f"{c} binary" for c in PACKED))
    tasks = groups * (groups + 1) // 2
    found = written(
        chunks.repartition(tasks, "pair").groupBy("pair").applyInArrow(
            _compare(groups, threshold, TILE), "node long, n long, u long, v long, a long, b long"
        ),
        "vector-links"
    )
    exact = written(_exact(found.where("a IS NOT NULL").select("a", "b"), classes, threshold), "vector-exact")
    counted = found.where("node IS NOT NULL").select("node", "n").union(exact.select("a", "copies_b")).union(exact.select("b", "copies_a"))
    links = counted.groupBy("node").agg(F.sum("n").alias("linked"))
    own = base.where("key IS NOT NULL").select("vec_id", "key").join(classes.select("key", "rep", "copies"), "key")
    same = own.select(F.col("vec_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    grouped = components(found.where("u IS NOT NULL").select("u", "v").union(exact.select("a", "b")).union(same))
    direct = own.join(links, own["rep"] == links["node"], "left").select(
        "vec_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = direct.unionByName(base.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    out = out.join(grouped, out["vec_id"] == grouped["node"], "left").select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _exact(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose cosine reaches the threshold in double precision, with their numbers of rows."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("copies").alias(f"copies_{c}"), F.col("vector").alias(f"vector_{c}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    va, vb = F.col("vector_a"), F.col("vector_b")
    return x.where(dot(va, vb) / F.sqrt(dot(va, va)) / F.sqrt(dot(vb, vb)) >= threshold).select("a", "b", "copies_a", "copies_b")


#: The contract's rows in DuckDB SQL over embeddings (vec_id unique), for small tables.
NEAR_DUPLICATES_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, list_dot_product(x, x) AS nn FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.nn > 0 AND b.nn > 0 AND len(a.x) = len(b.x)
      WHERE list_dot_product(a.x, b.x) / sqrt(a.nn) / sqrt(b.nn) >= 0.95),
c(n, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.n)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, min(c.r) AS component_id, min(c.r) = v.vec_id AS kept
FROM v JOIN c ON c.n = v.vec_id GROUP BY v.vec_id"""


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
