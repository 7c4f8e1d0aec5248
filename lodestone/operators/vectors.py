"""Geometry of embeddings: norms, centroids, covariance, neighbours, spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pool import shuffled


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(df: DataFrame, vector: str = "embedding", out: str = "z") -> DataFrame:
    n = norm(F.col(vector))
    return df.withColumn("n ", n).withColumn(out, F.transform(vector, lambda x: x.cast("double") / F.col("n "))).drop("n ")


def coordinates(df: DataFrame, keep: list[str], vector: str) -> DataFrame:
    return df.select(*keep, F.posexplode(vector).alias("dim", "x"))


def centroids(df: DataFrame, by: list[str], vector: str = "z") -> DataFrame:
    """(by, dim, mean): partial sums by (group, dimension), so the shuffle has groups * dimensions rows a task."""
    return coordinates(df, by, vector).groupBy(*by, "dim").agg(F.avg("x").alias("mean"))


def centroid_vectors(df: DataFrame, by: list[str], vector: str = "z") -> DataFrame:
    """(by, center): the mean vector of each group, one row a group."""
    c = centroids(df, by, vector)
    return c.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("center"))


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance with n - 1): Gram matrices of Arrow batches are added up by tasks.

    A task sends one matrix; a tree of partial sums keeps what the driver receives to a few matrices.
    """
    import pyarrow as pa

    width = df.select(F.max(F.size(vector))).first()[0] or 0

    def gram(batches):
        n, s, g = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    parts = df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(gram, "n long, s array<double>, g array<double>")
    cells = parts.select(
        "n", F.posexplode(F.concat("s", "g")).alias("i", "v")
    ).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    v = np.zeros(width + width * width)
    n = 0
    for r in cells:
        v[r["i"]], n = r["v"], r["n"]
    mean = v[:width] / max(1, n)
    cov = (v[width:].reshape(width, width) - n * np.outer(mean, mean)) / max(1, n - 1)
    return n, mean, cov


def neighbours(queries: DataFrame, bank: DataFrame, k: int, key: str = "id", vector: str = "z") -> DataFrame:
    """(q, b, cos, rank): the k nearest of the bank for every query, itself left out; ties by id.

    An exact scan: queries against all rows of the bank in blocks. Each task multiplies its queries
    with one block of the bank and keeps k a query, so the shuffle has k rows per query and block.
    """
    import pyarrow as pa

    rows = bank.count()
    blocks, parts = max(1, -(-rows // 8192)), max(1, -(-queries.count() // 8192))
    at = F.pmod(F.xxhash64(key), F.lit(blocks))
    b = bank.select(at.alias("block"), F.lit(1).alias("side"), F.col(key).cast("long").alias("i"), F.col(vector).alias("v"))
    q = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(0).alias("side"),
        F.col(key).cast("long").alias("i"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")
    )
    both = q.unionByName(b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))))

    def best(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("i").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        qi, bi = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        bi = bi[np.argsort(ids[bi], kind="stable")]
        out = []
        for s in range(0, len(qi), 256):
            p = qi[s : s + 256]
            cos = np.round(x[p] @ x[bi].T, 9)
            cos[ids[p][:, None] == ids[bi][None, :]] = -np.inf
            top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            r = np.repeat(np.arange(len(p)), top.shape[1])
            c = cos[r, top.ravel()]
            ok = np.isfinite(c)
            out.append((ids[p][r][ok], ids[bi][top.ravel()][ok], c[ok]))
        cols = [
            np.concatenate(o) if out else np.empty(0) for o in zip(*out, strict=True)
        ] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"q": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "cos": pa.array(cols[2], pa.float64())})

    found = both.groupBy("block", "part").applyInArrow(best, "q long, b long, cos double")
    order = Window.partitionBy("q").orderBy(F.col("cos").desc(), "b")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def spectrum(cov: np.ndarray) -> np.ndarray:
    return np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)


def components_for(values: np.ndarray, share: float) -> int:
    """Number of leading eigenvalues that reach the share of the variance."""
    return int(np.searchsorted(np.cumsum(values) / values.sum(), share, "left")) + 1


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared cosine of the principal angles of two orthonormal bases (columns)."""
    return float(((a.T @ b) ** 2).sum() / min(a.shape[1], b.shape[1]))


def half_splits(df: DataFrame, rounds: int, key: str, seed: str = "half") -> DataFrame:
    """(round, half, place, ...): each round deals the rows to two halves of n // 2 in random order.

    An odd row is left out, so the halves pair up place by place. No task orders a round.
    """
    n = df.agg(F.floor(F.count("*") / 2).alias("m "))  # one row
    x = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    x = x.withColumn("k ", F.concat_ws(":", F.col("round").cast("string"), F.col(key).cast("string")))
    x = shuffled(x, ["round"], "k ", seed, "r ").withColumn("r ", F.col("r ") - 1).crossJoin(F.broadcast(n)).where("`r ` < 2 * `m `")
    return x.withColumn(
        "half", F.floor(F.col("r ") / F.col("m ")).cast("int")
    ).withColumn("place", F.pmod(F.col("r "), F.col("m "))).drop("r ", "m ", "k ")


def pair_mean(df: DataFrame, value, key: str = "id", vector: str = "z", block: int = 2048) -> DataFrame:
    """(pairs, total): how many pairs of different rows there are, and the sum of ``value`` of their dot products.

    ``value`` maps a numpy array of products. Rows are dealt to blocks of about ``block``; every pair of blocks is
    one tile, multiplied in its own task, and one sum a tile leaves it.
    """
    import pyarrow as pa

    blocks = max(1, -(-df.count() // block))
    mine = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    x = df.select(mine.alias("b"), F.col(vector).alias("v")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = x.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "v")

    def tile(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        i, j, b = (table.column(c).to_numpy() for c in ("i", "j", "b"))
        if i[0] == j[0]:
            m = value(v @ v.T)
            n, total = len(v) * (len(v) - 1), m.sum() - np.trace(m)
        else:
            m = value(v[b == i[0]] @ v[b == j[0]].T)
            n, total = 2 * m.size, 2 * m.sum()
        return pa.table({"pairs": pa.array([n], pa.int64()), "total": pa.array([float(total)])})

    return tiles.groupBy("i", "j").applyInArrow(tile, "pairs long, total double").agg(
        F.sum("pairs").alias("pairs"), F.sum("total").alias("total")
    )


def shrunk(n: int, cov: np.ndarray, fourth: float) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf: (1 - a) * cov + a * (trace / d) * I with the a that loses least; ``cov`` with divisor n.

    ``fourth`` is the sum over the centered rows of their squared length, squared.
    """
    d = len(cov)
    level = np.trace(cov) / d
    spread = (cov**2).sum() / d - level**2
    noise = min(spread, (fourth / n - (cov**2).sum()) / (d * n))
    a = noise / spread if spread > 0 and noise > 0 else 0.0
    return (1 - a) * cov + a * level * np.eye(d), float(a)
