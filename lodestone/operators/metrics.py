"""Rank statistics, curves, thresholds and resampling intervals over (score, label) rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import uniform, uniform_sql


#: Quantiles at which the values of a column are cut to rank them.
RANK_CUTS = 256


def _stacked(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, v, m, start): every distinct value, its rows, and the rows of the group below it.

    The values are cut at approximate quantiles into runs, and ``start`` is what lies in the runs before plus what
    lies below within the run: no task sorts a group.
    """
    keys = [f"{c} " for c in by]
    values = df.groupBy(
        *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(x).alias("v ")
    ).agg(F.count("*").alias("m ")).where("`v ` IS NOT NULL")
    shares = F.array(*[F.lit(i / RANK_CUTS) for i in range(1, RANK_CUTS)])
    cuts = values.groupBy(*keys).agg(F.percentile_approx("v ", shares, F.lit(4096)).alias("cuts "))  # one row a group
    joined = _joined(values, cuts, keys).withColumn("run ", F.size(F.filter("cuts ", lambda q: q < F.col("v "))))
    before = Window.partitionBy(*keys).orderBy("run ").rowsBetween(Window.unboundedPreceding, -1)  # at most RANK_CUTS rows a group
    runs = joined.groupBy(*keys, "run ").agg(F.sum("m ").alias("all ")).select(
        *keys, "run ", F.coalesce(F.sum("all ").over(before), F.lit(0)).alias("o ")
    )
    within = Window.partitionBy(*keys, "run ").orderBy("v ").rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(joined, runs, [*keys, "run "])
    return out.select(*keys, "v ", "m ", (F.col("o ") + F.coalesce(F.sum("m ").over(within), F.lit(0))).alias("start "))


def _joined(x: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """With a table of few rows a group, null keys included."""
    if not keys:
        return x.crossJoin(F.broadcast(small))
    other = small.select(*[F.col(k).alias(f"{k}2") if k in keys else F.col(k) for k in small.columns])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}2"))
    return x.join(F.broadcast(other), same).drop(*[f"{k}2" for k in keys])


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with each column replaced by its rank from 1, ties sharing their mean."""
    out = df
    for c in columns:
        ranks = _stacked(df, c, []).select("v ", (F.col("start ") + (F.col("m ") + 1) / F.lit(2.0)).cast("double").alias("rank "))
        out = out.join(ranks, F.col(c) == F.col("v "), "left").withColumn(c, F.col("rank ")).drop("v ", "rank ")
    return out


def quantiles(df: DataFrame, x: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q): the exact quantiles of a column in an array, interpolated between neighbours; nulls are left out."""
    by = by or []
    keys = [f"{c} " for c in by]
    stacked = _stacked(df, x, by)
    n = stacked.groupBy(*keys).agg(F.sum("m ").alias("n "))  # one row a group
    wanted = n.select(*keys, F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("i ", "share "), "n ")
    at = wanted.withColumn("p ", F.col("share ") * (F.col("n ") - 1)).withColumn("lo ", F.floor("p ")).withColumn("hi ", F.ceil("p "))
    found = _joined(stacked, at, keys).where(
        "(`lo ` >= `start ` AND `lo ` < `start ` + `m `) OR (`hi ` >= `start ` AND `hi ` < `start ` + `m `)"
    )
    inside = lambda c: F.max(F.when((F.col(c) >= F.col("start ")) & (F.col(c) < F.col("start ") + F.col("m ")), F.col("v ").cast("double")))
    ends = found.groupBy(*keys, "i ").agg(
        inside("lo ").alias("a "), inside("hi ").alias("b "), F.max(F.col("p ") - F.col("lo ")).alias("f ")
    )
    value = F.col("a ") + F.col("f ") * (F.col("b ") - F.col("a "))
    rows = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("i ").alias("i"), value.alias("v")))).alias("r "))
    return rows.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.transform("r ", lambda r: r["v"]).alias("q"))


def by_value(df: DataFrame, score: str, label: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Positives and negatives at each distinct score: the only shuffle that curves and areas need of the rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*by, F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("n")
    )


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, positives, negatives, auroc): the share of pairs in which the positive scores higher, ties half.

    Counts are folded to distinct scores first; the cumulative sum then runs over values, not rows.
    """
    by = by or []
    v = by_value(df, score, label, by, weight)
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = v.withColumn("u", F.col("p") * (below + F.col("n") / 2))
    out = x.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("u").alias("u"))
    return out.select(*by, "positives", "negatives", F.try_divide("u", F.col("positives") * F.col("negatives")).alias("auroc"))


def roc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, fpr, tpr): one point per distinct score, thresholds descending, all points kept."""
    by = by or []
    v = by_value(df, score, label, by)
    desc = Window.partitionBy(*by).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by)
    cum = lambda c: F.try_divide(F.sum(c).over(desc), F.sum(c).over(every))
    return v.select(*by, F.col("s").alias("threshold"), cum("n").alias("fpr"), cum("p").alias("tpr"))


def tpr_at(points: DataFrame, target: float, by: list[str] | None = None) -> DataFrame:
    """(by, tpr, threshold): the best point of a ROC with fpr <= target; 0 and null where there is none."""
    by = by or []
    ok = F.col("fpr") <= target
    best = F.max(F.when(ok, F.struct("tpr", (F.col("threshold")).alias("threshold"))))
    return points.groupBy(*by).agg(best.alias("b")).select(
        *by, F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"), F.col("b.threshold").alias("threshold")
    )


def partial_auroc(points: DataFrame, most: float, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC up to fpr = most, scaled to 0.5 for chance and 1 for perfect."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(F.col("threshold").desc())
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(0.0))
    x = points.select(*by, "fpr", "tpr", before("fpr").alias("f0"), before("tpr").alias("t0")).where(F.col("f0") < most)
    cut = F.least("fpr", F.lit(most))
    at_cut = F.when(F.col("fpr") <= most, F.col("tpr")).otherwise(
        F.col("t0") + (F.col("tpr") - F.col("t0")) * (most - F.col("f0")) / (F.col("fpr") - F.col("f0"))
    )
    area = F.sum((cut - F.col("f0")) * (F.col("t0") + at_cut) / 2)
    low, high = most * most / 2, most
    return x.groupBy(*by).agg(area.alias("area")).select(*by, (0.5 * (1 + (F.col("area") - low) / (high - low))).alias("pauc"))


def rates(df: DataFrame, label: str, decision: str, by: list[str] | None = None) -> DataFrame:
    """(by, fpr, fnr) of 0/1 decisions."""
    d = F.col(decision).cast("double")
    return df.groupBy(*(by or [])).agg(
        F.avg(F.when(F.col(label) == 0, d)).alias("fpr"), F.avg(F.when(F.col(label) == 1, 1 - d)).alias("fnr")
    )


def rank_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(r_a_b for every pair): correlations of average ranks."""
    ranked = average_ranks(df.select(*columns), columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return ranked.agg(*[F.corr(a, b).alias(f"r_{a}_{b}") for a, b in pairs])


def quantile_bin(df: DataFrame, x: str, bins: int, by: list[str] | None = None, name: str = "bin") -> DataFrame:
    """Adds the number of inner quantile edges that are at most x (exact, interpolated quantiles)."""
    by = by or []
    e = quantiles(df, x, [i / bins for i in range(1, bins)], by).withColumnRenamed("q", "edges ")
    joined = df.join(F.broadcast(e), by) if by else df.crossJoin(F.broadcast(e))  # one row of edges a group
    return joined.withColumn(name, F.size(F.filter("edges ", lambda q: q <= F.col(x)))).drop("edges ")


#: Cumulative shares of 0, 1, 2, ... in a Poisson distribution of mean 1, as far as a number of 32 bits can tell.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(11)]


def resampled(df: DataFrame, rounds: int, key: str, seed: str = "boot") -> DataFrame:
    """Bootstrap by weights: for each round every row with the number of times it is drawn (column times).

    The numbers are Poisson draws of mean 1 from a hash of (round, key), so rows need no numbering, nothing is
    joined, a round's sums are aggregated where the rows lie, and any engine draws the same. Rows drawn no time are left out.
    """
    x = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = uniform(F.concat_ws(":", F.col("round").cast("string"), F.col(key).cast("string")), seed)
    times = sum((u >= c).cast("int") for c in POISSON)
    return x.withColumn("times", times).where("times > 0")


def resampled_sql(source: str, rounds: int, key: str, seed: str = "boot") -> str:
    u = uniform_sql(f"concat_ws(':', CAST(round AS VARCHAR), CAST({key} AS VARCHAR))", seed)
    times = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in POISSON)
    return f"(SELECT * FROM (SELECT *, {times} AS times FROM (SELECT *, {u} AS u FROM {source}, range(0, {rounds}) t(round))) WHERE times > 0)"
