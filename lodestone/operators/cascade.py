"""Two-threshold routing between a cheap score and an expensive judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import quantiles

INF = float("inf")


def gray(score: Column, low: Column, high: Column, flag: Column | None = None) -> Column:
    """True where the judge decides: strictly between the thresholds, or flagged."""
    g = (score > low) & (score < high)
    return g | flag if flag is not None else g


def cuts(df: DataFrame, score: str, grid: int, by: list[str] | None = None) -> DataFrame:
    """(by, cut): distinct quantiles at grid points, and both infinities; at most grid + 2 rows a group."""
    q = quantiles(df, score, [i / (grid - 1) for i in range(grid)], by)
    x = q.select(*(by or []), F.array_union(F.transform("q", lambda v: F.round(v, 9)), F.array(F.lit(-INF), F.lit(INF))).alias("c"))
    return x.select(*(by or []), F.explode("c").alias("cut"))


def threshold_grid(df: DataFrame, score: str, label: str, judge: str, grid: int, by: list[str] | None = None) -> DataFrame:
    """(by, t_low, t_high, share, fpr, fnr, errors) for every pair of cuts low <= high.

    Rows are folded to counts per cell between cuts; the quadratic part runs over cuts only. With
    prefix sums over cells a pair costs two lookups: rows up to low are safe, rows from
    high on are harm, the judge decides between.
    """
    by = by or []
    c = cuts(df, score, grid, by)
    arr = c.groupBy(*by).agg(F.array_sort(F.collect_list("cut")).alias("cs "))
    x = df.join(F.broadcast(arr), by) if by else df.crossJoin(F.broadcast(arr))
    x = x.withColumn("s ", F.round(F.col(score).cast("double"), 9))
    # the cell of a score: cuts strictly below it, and whether it equals the next one
    cell = F.size(F.filter("cs ", lambda v: v < F.col("s ")))
    equal = F.exists("cs ", lambda v: v == F.col("s ")).cast("int")
    ind = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    cells = x.groupBy(*by, (cell * 2 + equal).alias("k")).agg(
        F.count("*").alias("n"), ind(F.col(label) == 0).alias("neg"), ind(F.col(label) == 1).alias("pos"),
        ind((F.col(label) == 0) & (F.col(judge) == 1)).alias("jneg"), ind((F.col(label) == 1) & (F.col(judge) == 0)).alias("jpos")
    )
    # a cut with i cuts below it sits between k = 2 i (scores below it) and k = 2 i + 1 (scores equal to it)
    places = c.join(F.broadcast(arr), by) if by else c.crossJoin(F.broadcast(arr))
    places = places.select(*by, "cut", (F.size(F.filter("cs ", lambda v: v < F.col("cut"))) * 2).alias("place"))
    sums = ("n", "neg", "pos", "jneg", "jpos")
    up = places.join(cells, by) if by else places.crossJoin(F.broadcast(cells))
    pre = up.groupBy(*by, "cut", "place").agg(
        *[F.sum(F.when(F.col("k") <= F.col("place"), F.col(m)).otherwise(0)).alias(f"lt_{m}") for m in sums],
        *[F.sum(F.when(F.col("k") <= F.col("place") + 1, F.col(m)).otherwise(0)).alias(f"le_{m}") for m in sums],
        *[F.sum(m).alias(f"all_{m}") for m in sums]
    )
    a, b = pre.alias("a"), pre.alias("b")
    cond = F.col("a.cut") <= F.col("b.cut")
    for g in by:
        cond = cond & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    p = a.join(b, cond)
    mid = lambda m: F.greatest(F.col(f"b.lt_{m}") - F.col(f"a.le_{m}"), F.lit(0))
    share = mid("n") / F.col("a.all_n")
    fpr = (mid("jneg") + F.col("a.all_neg") - F.col("b.lt_neg")) / F.col("a.all_neg")
    fnr = (mid("jpos") + F.col("b.lt_pos") - mid("pos")) / F.col("a.all_pos")
    return p.select(
        *[F.col(f"a.{g}").alias(g) for g in by], F.col("a.cut").alias("t_low"), F.col("b.cut").alias("t_high"), share.alias("share"),
        fpr.alias("fpr"), fnr.alias("fnr"), (fpr + fnr).alias("errors")
    )


def operating_point(grid: DataFrame, judge: DataFrame, delta: float, cap: float, by: list[str] | None = None) -> DataFrame:
    """The least share, then least errors, among points within delta of the judge's rates (table fpr, fnr)."""
    by = by or []
    j = judge.select(*by, F.col("fpr").alias("jf"), F.col("fnr").alias("jn"))
    x = grid.join(F.broadcast(j), by) if by else grid.crossJoin(F.broadcast(j))
    ok = x.where((F.col("fpr") <= F.col("jf") + delta + 1e-12) & (F.col("fnr") <= F.col("jn") + delta + 1e-12))
    best = ok.groupBy(*by).agg(F.min(F.struct("share", F.round("errors", 9).alias("errors"), "t_low", "t_high", "fpr", "fnr")).alias("b"))
    return best.select(*by, "b.t_low", "b.t_high", "b.share", "b.fpr", "b.fnr", (F.col("b.share") <= cap + 1e-12).alias("within_cap"))


def zone_shares(df: DataFrame, score: str, low: Column, high: Column, flag: Column) -> DataFrame:
    core = gray(F.col(score), low, high)
    harm = (F.col(score) >= high) & ~flag
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(
        share(~core & ~flag & ~harm).alias("auto_safe"), share(harm).alias("auto_harm"), share(core).alias("judge_gray"),
        share(flag & ~core).alias("judge_ood")
    )
