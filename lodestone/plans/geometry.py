"""Queries on similarity and embeddings: TF-IDF, matching, centroids, neighbours, spectra."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pairs as P
from ..operators import pool as pl
from ..operators import similarity as S
from ..operators import vectors as V
from ..sources import stores
from ..sources.tables import hashed_sql, load, uniform, uniform_sql
from .prompts import _JB, POOL, the_pool

STOP = ("the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "by", "an", "at", "are", "or")
#: Fits of one model from different starts that run at the same time.
FITS_AT_ONCE = 8


def _r(c, n: int = 6):
    return F.round(c, n)


def _turns(s, d) -> DataFrame:
    """Short labelled texts: conversation turns, grouped by role."""
    return load(s, d, "conversations").where("text IS NOT NULL").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "text"
    )


def tfidf_weights(s, d):
    """Term weights of the pool's prompts."""
    return S.tfidf(S.terms(the_pool(s, d).select("id", "prompt"), "prompt", "id"), "id").select("id", "term", _r("weight").alias("weight"))


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _tfidf_sql(source: str, key: str, sub: bool, by: str = "", found: str = f"unnest({_TOK})") -> str:
    g, j = (f"{by}, ", f"{by}, ") if by else ("", "")
    part = f"PARTITION BY {by}, {key}" if by else f"PARTITION BY {key}"
    tf = "(1 + ln(tf))" if sub else "tf"
    nn = f"n AS (SELECT {by}, count(DISTINCT {key}) AS n FROM tf GROUP BY {by})" if by else f"n AS (SELECT count(DISTINCT {key}) AS n FROM tf)"
    jn = f"JOIN n USING ({by})" if by else "CROSS JOIN n"
    return f"""tk AS (SELECT {g}{key}, {found} AS term FROM {source}),
tf AS (SELECT {g}{key}, term, count(*) AS tf FROM tk GROUP BY ALL), {nn}, df AS (SELECT {j}term, count(*) AS df FROM tf GROUP BY ALL),
rw AS (SELECT {g}{key}, term, {tf} * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df USING ({j}term) {jn}),
wt AS (SELECT {g}{key}, term, raw / sqrt(sum(raw * raw) OVER ({part})) AS weight FROM rw)"""


def _similar(p: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Pairs of one group's prompts whose cosine lies in a band, the groups' terms weighed apart."""
    p = stores.stored(p, "prompts")
    counts = stores.stored(S.terms(p, "prompt", "id").join(p.select("id", *by), "id"), "counts")
    # stored, as scores are costly to find again
    found = stores.stored(S.similar_pairs(counts, "id", by, low - 1e-6), "similar")
    return found.withColumn("score", _r("score")).where(F.col("score").between(low, high))


def tfidf_paraphrase(s, d, low: float = 0.35, high: float = 0.95):
    """Pairs of the pool's prompts of one label and category in a band of cosines."""
    p = the_pool(s, d).select("id", "prompt", "label", F.coalesce("primary_category", F.lit("")).alias("category"))
    return _similar(p, ["label", "category"], low, high).select("label", "category", "a", "b", "score")


def paraphrase_allocated(s, d, n: int = 400, low: float = 0.2, high: float = 0.95):
    """n pairs of similar prompts: half within a harm category, allocated by square roots, the rest among safe prompts, both at random."""
    p = stores.stored(the_pool(s, d).select("id", "prompt", "label", "primary_category"), "pool")
    pair = F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"))
    harm = _similar(
        p.where("label = 'harm'").select("id", "prompt", "primary_category"), ["primary_category"], low, high
    ).withColumn("pair", pair)
    safe = _similar(p.where("label = 'safe'").select("id", "prompt", F.lit("").alias("all")), ["all"], low, high).withColumn("pair", pair)
    chosen = stores.stored(pl.sampled_by_category(harm, n // 2, key="pair").select("primary_category", "a", "b", "score"), "harm-chosen")
    taken = chosen.agg(F.count("*").alias("taken"))  # one row
    # only the first n of the random order can be chosen, so the others are not ranked
    rest = pl.shuffled(pl.sample(safe, n, "pair"), [], "pair").crossJoin(F.broadcast(taken)).where(F.col("rank") <= n - F.col("taken"))
    return chosen.unionByName(rest.select(F.lit(None).cast("string").alias("primary_category"), "a", "b", "score"))


def neardup_anti(s, d, most: float = 0.9):
    """Documents that are no copy of a benchmark text: neither the same words, nor a 1-2-gram cosine of ``most`` or more."""
    held = load(s, d, "benchmark").where("text IS NOT NULL").select((-1 - F.col("item_id")).alias("id"), "text")
    docs = load(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    # white space is in no word, so only equal texts need it collapsed
    near = S.near_keys(held.union(docs), "text", "id", "id >= 0", "id < 0", most)
    # digests, so that no text is shuffled
    digest = F.sha2(X.collapsed(F.col("text")), 256).alias("digest")
    same = docs.select("id", digest).join(held.select(digest).distinct(), "digest", "left_semi").select("id")
    return docs.select("id").join(near.union(same).distinct(), "id", "left_anti")


def hard_negatives(s, d, n: int = 100):
    """For n harm prompts of the pool, their categories allocated by square roots, the most similar unused safe prompt."""
    p = stores.stored(the_pool(s, d).select("id", "prompt", "label", "primary_category"), "pool")
    harm, safe = stores.stored(pl.sampled_by_category(p.where("label = 'harm'"), n), "harm"), p.where("label = 'safe'")
    stop = s.createDataFrame([(w,) for w in STOP], "term string")
    chosen = harm.select("id", "prompt", "label").union(safe.select("id", "prompt", "label"))
    w = stores.stored(
        S.tfidf(S.terms(chosen, "prompt", "id"), "id", sublinear=True, stop=stop).join(chosen.select("id", "label"), "id"), "weights"
    )
    sim = S.cosine_pairs(w.where("label = 'harm'"), w.where("label = 'safe'"), "id").withColumn("score", _r("score"))
    out = P.matched_by_score(harm, safe, stores.stored(sim, "similar"), n)
    return out.select(F.col("left_id").alias("harm_id"), F.col("right_id").alias("safe_id"), "score")


def _by_length(s, d, choose, most: int | None = None):
    p = the_pool(s, d)
    if most:
        p = p.where(F.col("chars") <= most).where(~X.is_jailbreak_like(F.col("prompt")))
    p = stores.stored(p.select("id", "label", "chars"), "lengths")
    out = P.matched_by_length(p.where("label = 'harm'"), p.where("label = 'safe'"), choose)
    return out.select(
        F.col("left_id").alias("harm_id"), F.col("right_id").alias("safe_id"), F.col("left_chars").alias("harm_chars"),
        F.col("right_chars").alias("safe_chars")
    )


def length_matched_wraps(s, d):
    """Harm prompts in random order, each with the unused safe prompt nearest in length."""
    return _by_length(s, d, P.nearest, 1000)


def length_match_range(s, d):
    """Harm prompts in random order, each with the shortest unused safe prompt within a quarter of its length."""
    return _by_length(s, d, P.shortest_within(0.25))


def _z(s, d) -> DataFrame:
    return V.unit(load(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("label") % 2).alias("y"), "embedding"))


_Z = """nz AS (SELECT vec_id AS id, label, label % 2 AS y, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings),
z AS (SELECT id, label, y, e, nrm, list_transform(e, lambda x: x / nrm) AS z FROM nz)"""


def l2_normalize(s, d):
    z = _z(s, d)
    return z.select("id", _r(V.norm(F.col("z"))).alias("norm"), _r(F.element_at("z", 1)).alias("first"))


def describe_embeddings(s, d):
    e = load(s, d, "embeddings").withColumn("nrm", V.norm(F.col("embedding")))
    q = F.percentile("nrm", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    r = e.groupBy("label").agg(
        F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n"), _r(F.avg("nrm")).alias("mean_norm"),
        _r(F.stddev_samp("nrm")).alias("std_norm_samp"), q.alias("q")
    )
    return r.select(
        "label", "dim", "n", "mean_norm", "std_norm_samp", *[_r(F.col("q")[i]).alias(f"q{p}") for i, p in enumerate((25, 50, 75))]
    )


def class_centroids(s, d):
    return V.centroids(_z(s, d), ["label"]).select("label", "dim", _r("mean").alias("mean"))


def centroid_scores(s, d):
    """cos to the harm center minus cos to the safe center; centers are two broadcast rows."""
    z = _z(s, d)
    c = V.centroid_vectors(z, ["y"]).select("y", F.transform("center", lambda x: x).alias("center"))
    c = c.select("y", "center", V.norm(F.col("center")).alias("nc")).groupBy().agg(
        F.max(F.when(F.col("y") == 1, F.struct("nc", "center"))).alias("h"),
        F.max(F.when(F.col("y") == 0, F.struct("nc", "center"))).alias("s")
    )
    x = z.crossJoin(F.broadcast(c))
    return x.select(
        "id", _r(V.dot(F.col("z"), F.col("h.center")) / F.col("h.nc") - V.dot(F.col("z"), F.col("s.center")) / F.col("s.nc")).alias("score")
    )


_CENTERS = """cd AS (SELECT y, i, avg(z[i]) AS m FROM z, range(1, 65) r(i) GROUP BY y, i), cv AS (SELECT y, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS nc FROM cd GROUP BY y)"""


def _near(s, d, k: int = 10):
    z = _z(s, d).select("id", "label", "y", "z")
    return z, V.neighbours(z, z, k)


_NN = "nn AS (SELECT * FROM (SELECT a.id AS q, b.id AS b, round(list_dot_product(a.z, b.z), 9) AS cos, b.y AS yb, b.label AS bl, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.z, b.z), 9) DESC, b.id) AS rank FROM z a JOIN z b ON a.id <> b.id) WHERE rank <= {0})"


def knn_topk(s, d):
    return _near(s, d)[1].select("q", "b", _r("cos").alias("cos"), "rank")


def knn_classify(s, d, k: int = 5):
    """Share of harm among the k nearest of distinct groups, weighted by similarity; 5k candidates."""
    z, n = _near(s, d, 5 * k)
    n = n.join(z.select(F.col("id").alias("b"), F.col("y").alias("by"), (F.col("id") % 50).alias("grp")), "b")
    first = pl.ranked(n, ["q", "grp"], F.col("rank"), "in_group").where("in_group = 1")
    best = pl.ranked(first, ["q"], F.col("rank"), "place").where(F.col("place") <= k)
    w = F.greatest("cos", F.lit(0.0)) + 1e-6
    return best.groupBy("q").agg(_r(F.sum(w * F.col("by")) / F.sum(w)).alias("score"))


def knn_diff(s, d, k: int = 5):
    """Mean cosine of the k nearest harm rows minus that of the k nearest safe rows; 1 - k-th cosine of all."""
    z = _z(s, d).select("id", "y", "z")
    sides = [V.neighbours(z, z.where(F.col("y") == y), k).withColumn("side", F.lit(y)) for y in (0, 1)]
    both = sides[0].unionByName(sides[1])
    over = pl.ranked(both, ["q"], [F.col("cos").desc(), F.col("b")], "of_all")
    return over.groupBy("q").agg(
        _r(F.avg(F.when(F.col("side") == 1, F.col("cos"))) - F.avg(F.when(F.col("side") == 0, F.col("cos")))).alias("knn_diff"),
        _r(1 - F.max(F.when(F.col("of_all") == k, F.col("cos")))).alias("ood_knn")
    )


def _sums(z: DataFrame, by: list[str]) -> DataFrame:
    """Closed forms of mean cosines: squared norm of the sum of unit vectors, and rows."""
    c = V.coordinates(z, by, "z").groupBy(*by, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return c.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))


def geometry_metrics(s, d):
    """Mean cosine and normalised alignment in closed form, kNN purity by an exact scan, uniformity over tiles of all pairs,
    and the participation ratio, which is trace(C)^2 / sum of the squared entries of the covariance C."""
    z, n = _near(s, d)
    a = _sums(z, []).select(((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cos"))
    within = _sums(z, ["y"]).agg((F.sum(F.col("ss") - F.col("n")) / F.sum(F.col("n") * (F.col("n") - 1))).alias("own_cos"))
    y = z.select("id", "y")
    pure = n.join(y.withColumnRenamed("id", "q").withColumnRenamed("y", "qy"), "q").join(y.withColumnRenamed("id", "b").withColumnRenamed("y", "by"), "b").agg(
        F.avg((F.col("qy") == F.col("by")).cast("double")).alias("purity")
    )
    spread = V.pair_mean(z, lambda cos: np.exp(-2 * np.clip(2 - 2 * cos, 0, None))).select(
        F.log(F.col("total") / F.col("pairs")).alias("uniformity")
    )
    cov = V.moments(load(s, d, "embeddings"), "embedding")[2]
    ratio = float(np.trace(cov) ** 2 / (cov**2).sum()) if cov.any() else None
    out = a.crossJoin(within).crossJoin(pure).crossJoin(spread)  # one row each
    return out.select(
        _r("mean_cos").alias("mean_cos"), _r((2 - 2 * F.col("own_cos")) / (2 - 2 * F.col("mean_cos"))).alias("alignment"),
        _r("purity").alias("knn_purity"), _r("uniformity").alias("uniformity"), _r(F.lit(ratio), 4).alias("participation")
    )


def category_purity(s, d):
    z, n = _near(s, d)
    y = z.select("id", "label")
    p = n.join(
        y.withColumnRenamed("id", "q").withColumnRenamed("label", "ql"), "q"
    ).join(y.withColumnRenamed("id", "b").withColumnRenamed("label", "bl"), "b").agg(F.avg((F.col("ql") == F.col("bl")).cast("double")).alias("purity"))
    shares = z.groupBy("label").count().withColumn(
        "p", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1)))
    ).agg(F.sum(F.col("p") * F.col("p")).alias("chance"))
    return p.crossJoin(shares).select(_r("purity").alias("purity"), _r("chance").alias("chance"))


def embedding_covariance(s, d):
    _, _, cov = V.moments(load(s, d, "embeddings"), "embedding")
    return s.createDataFrame(
        [(i, j, round(float(cov[i, j]), 6)) for i in range(len(cov)) for j in range(len(cov))], "i int, j int, cov double"
    )


def pca_components(s, d):
    """Eigenvalues by rank with the cumulative share, and how many reach 90 %."""
    v = V.spectrum(V.moments(load(s, d, "embeddings"), "embedding")[2])
    if not np.isfinite(v).all() or not v.sum() > 0:
        raise ValueError("the vectors have no finite variance")
    share, k = np.cumsum(v) / v.sum(), V.components_for(v, 0.9)
    return s.createDataFrame(
        [(i + 1, float(round(x, 6)), float(round(c, 6)), i + 1 <= k) for i, (x, c) in enumerate(zip(v, share, strict=True))],
        "rank int, eigenvalue double, cumulative double, needed boolean"
    )


def _bases(s, d):
    e = load(s, d, "embeddings")
    out = []
    for y in (0, 1):
        cov = V.moments(e.where(F.col("label") % 2 == y), "embedding")[2]
        w, u = np.linalg.eigh(cov)
        out.append(u[:, ::-1][:, : V.components_for(V.spectrum(cov), 0.9)])
    return out


def pca_overlap(s, d):
    a, b = _bases(s, d)
    dims = (a.shape[1], b.shape[1])
    return s.createDataFrame(
        [(dims[0], dims[1], round(V.overlap(a, b), 6), round(max(dims) / a.shape[0], 6), round(V.overlap(a, a), 6))],
        "dim_safe int, dim_harm int, overlap double, chance double, self_overlap double"
    )


def _halves(s, d, rounds: int = 10):
    return V.half_splits(_z(s, d).select("id", "y", "z"), rounds, "id")


_HALF = f"""hs AS (SELECT id, y, z, round, row_number() OVER (PARTITION BY round ORDER BY {hashed_sql("concat_ws(':', CAST(round AS VARCHAR), CAST(id AS VARCHAR))", "half")}, id) - 1 AS r, count(*) OVER (PARTITION BY round) // 2 AS m FROM z, range(0, 10) t(round)),
hv AS (SELECT round, y, z, r // m AS half, r % m AS place FROM hs WHERE r < 2 * m)"""


def half_split_distance(s, d):
    """Mean cosine and Euclidean distance of rows paired by random half splits, by round."""
    h = _halves(s, d)
    a, b = (h.where(F.col("half") == k).select("round", "place", F.col("z").alias(f"z{k}")) for k in (0, 1))
    x = a.join(b, ["round", "place"]).withColumn("cos", V.dot(F.col("z0"), F.col("z1")))
    return x.groupBy("round").agg(
        _r(F.avg(1 - F.col("cos"))).alias("cos_distance"),
        _r(F.avg(F.sqrt(F.greatest(2 - 2 * F.col("cos"), F.lit(0.0))))).alias("l2_distance")
    )


def distance_ratio(s, d):
    """Cosine distance of the class centers over the mean distance of split halves."""
    c = V.centroid_vectors(_z(s, d), ["y"])
    a, b = (c.where(F.col("y") == k).select(F.col("center").alias(f"c{k}")) for k in (0, 1))
    between = a.crossJoin(b).select((1 - V.dot(F.col("c0"), F.col("c1")) / (V.norm(F.col("c0")) * V.norm(F.col("c1")))).alias("between"))
    within = half_split_distance(s, d).agg(F.avg("cos_distance").alias("within"))
    return between.crossJoin(within).select(
        _r("between").alias("between"), _r("within").alias("within"), _r(F.col("between") / F.col("within"), 4).alias("ratio")
    )


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from the contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    c2 = lambda x: x * (x - 1) / 2
    tot = lambda k: cells.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(c2(F.col("m"))).alias(f"s_{k}"))
    x = cells.agg(F.sum(c2(F.col("n"))).alias("s"), F.sum("n").alias("t")).crossJoin(tot(a)).crossJoin(tot(b))
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / c2(F.col("t"))
    return x.select(((F.col("s") - expected) / ((F.col(f"s_{a}") + F.col(f"s_{b}")) / 2 - expected)).alias("ari"))


def ari_contingency(s, d):
    """Cells by the sign pattern of the first coordinates against the labels; k-means clusters are in ``kmeans_ari``."""
    bit = lambda i: (F.element_at("embedding", i) > 0).cast("int")
    x = load(s, d, "embeddings").select("label", (bit(1) * 4 + bit(2) * 2 + bit(3)).alias("cluster"))
    return ari(x, "label", "cluster").select(_r("ari").alias("ari"))


def kmeans_ari(s, d, clusters: int = 10, starts: int = 10):
    """Adjusted Rand index of the labels and of the classes against k-means clusters of unit vectors, the best of several starts.

    A fit is a chain of small jobs, so FITS_AT_ONCE run side by side over the same cached vectors; each has its own seed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = stores.stored(_z(s, d).select("label", "y", array_to_vector("z").alias("features")), "unit")
    kinds = (("label", clusters), ("y", 2))
    cached = x.persist()
    with ThreadPool(FITS_AT_ONCE) as pool:
        fits = pool.starmap(
            lambda k, i: KMeans(k=k, seed=i, featuresCol="features", predictionCol="cluster").fit(cached),
            [(k, i) for _, k in kinds for i in range(starts)], 1
        )
    cached.unpersist()
    out = None
    for at, (name, _) in enumerate(kinds):
        best = min(fits[at * starts : (at + 1) * starts], key=lambda m: m.summary.trainingCost)
        a = ari(best.transform(x), name, "cluster").select(F.lit(name).alias("against"), _r("ari").alias("ari"))
        out = a if out is None else out.unionByName(a)
    return out


def twin_hit_at_k(s, d):
    """Share of vectors that find the twin (the next id of the same label) among their k nearest."""
    z, n = _near(s, d)
    nxt = F.lead("id").over(Window.partitionBy("label").orderBy("id"))
    twins = z.select(F.col("id").alias("q"), nxt.alias("twin")).where("twin IS NOT NULL")
    hit = twins.join(n, ["q"]).groupBy("q").agg(F.min(F.when(F.col("b") == F.col("twin"), F.col("rank"))).alias("at"))
    return hit.agg(
        F.count("*").alias("queries"),
        *[_r(F.avg(F.coalesce((F.col("at") <= k), F.lit(False)).cast("double"))).alias(f"hit_{k}") for k in (1, 5, 10)]
    )


def collapse_rules(s, d):
    """Which label groups count as collapsed against the reference group 0."""
    g = _sums(_z(s, d), ["label"]).select("label", ((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cos"))
    ref = g.where("label = 0").select(F.col("mean_cos").alias("ref"))
    x = g.crossJoin(F.broadcast(ref)).withColumn("limit", F.greatest(F.lit(0.05), (1 + F.col("ref")) / 2))
    reason = F.array_compact(
        F.array(F.when(F.col("mean_cos") > F.col("limit"), F.lit("mean_cos")), F.when(F.isnan("mean_cos"), F.lit("not_finite")))
    )
    return x.select("label", _r("mean_cos").alias("mean_cos"), _r("limit").alias("limit"), F.array_join(reason, ",").alias("reasons"))


def supcon_loss(s, d, tau: float = 0.1):
    """Weighted contrastive loss of batches of 32 vectors: positives share a label, weight 1; forward value only."""
    z = _z(s, d).select("id", "label", "z").withColumn("batch", F.floor(uniform(F.col("id"), "b") * 1000000).cast("long"))
    z = z.withColumn("batch", F.pmod(F.col("batch"), F.lit(max(1, -(-z.count() // 32)))))
    a, b = z.alias("a"), z.alias("b")
    p = a.join(b, (F.col("a.batch") == F.col("b.batch")) & (F.col("a.id") != F.col("b.id"))).select(
        F.col("a.batch").alias("batch"), F.col("a.id").alias("i"), (F.col("a.label") == F.col("b.label")).cast("double").alias("w"),
        (V.dot(F.col("a.z"), F.col("b.z")) / tau).alias("l")
    )
    w = Window.partitionBy("batch", "i")
    p = p.withColumn("lp", F.col("l") - F.log(F.sum(F.exp("l")).over(w)))
    rows = p.groupBy("batch", "i").agg(
        (-F.sum(F.col("w") * F.col("lp")) / F.sum("w")).alias("loss"), F.sum("w").alias("tw")
    ).where("tw > 0")
    return rows.groupBy("batch").agg(_r(F.avg("loss")).alias("loss"), F.count("*").alias("anchors"))


_PARA = "sm AS (SELECT a.id AS a, b.id AS b, round(sum(a.weight * b.weight), 6) AS score FROM wt a JOIN wt b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)"
_GRAMS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
_COLLAPSED = r"regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


def _pairs_sql(source: str, by: str, tag: str, low: float, high: float) -> str:
    w = f"""tk{tag} AS (SELECT {by}, id, unnest({_TOK}) AS term FROM {source}), tf{tag} AS (SELECT {by}, id, term, count(*) AS tf FROM tk{tag} GROUP BY ALL),
n{tag} AS (SELECT {by}, count(DISTINCT id) AS n FROM tf{tag} GROUP BY {by}), df{tag} AS (SELECT {by}, term, count(*) AS df FROM tf{tag} GROUP BY ALL),
rw{tag} AS (SELECT {by}, id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf{tag} JOIN df{tag} USING ({by}, term) JOIN n{tag} USING ({by})),
wt{tag} AS (SELECT {by}, id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {by}, id)) AS weight FROM rw{tag})"""
    return f"""{w}, sm{tag} AS (SELECT * FROM (SELECT {", ".join(f"a.{c}" for c in by.split(", "))}, a.id AS a, b.id AS b, round(sum(a.weight * b.weight), 6) AS score
FROM wt{tag} a JOIN wt{tag} b ON {" AND ".join(f"a.{c} = b.{c}" for c in [*by.split(", "), "term"])} AND a.id < b.id GROUP BY ALL) WHERE score BETWEEN {low} AND {high})"""


_PAIR_KEY = "concat_ws(':', CAST(a AS VARCHAR), CAST(b AS VARCHAR))"
_TURNS = f"""tu AS (SELECT id, chars, row_number() OVER (ORDER BY {hashed_sql("id")}, id) AS turn FROM eligible WHERE label = 'harm'),
seat AS (SELECT id, chars, row_number() OVER (PARTITION BY chars ORDER BY {hashed_sql("id")}, id) AS number FROM eligible WHERE label = 'safe')"""


def _matched_sql(where: str, wanted: str, order: str) -> str:
    """Rows in turn, each with the first unused seat that is wanted, by a recursive table whose rows carry the seats in use."""
    return f"""WITH RECURSIVE {POOL}, eligible AS (SELECT id, label, chars FROM pool{where}), {_TURNS},
m AS (SELECT 0::BIGINT AS turn, NULL::BIGINT AS harm_id, NULL::BIGINT AS safe_id, []::BIGINT[] AS used
UNION ALL SELECT turn, harm_id, safe_id, CASE WHEN safe_id IS NULL THEN used ELSE list_append(used, safe_id) END FROM
(SELECT tu.turn, tu.id AS harm_id, (SELECT arg_min(seat.id, ({order}, seat.chars, seat.number)) FROM seat WHERE NOT list_contains(m.used, seat.id) AND {wanted}) AS safe_id, m.used FROM m JOIN tu ON tu.turn = m.turn + 1))
SELECT harm_id, safe_id, CAST(tu.chars AS BIGINT) AS harm_chars, CAST(seat.chars AS BIGINT) AS safe_chars FROM m JOIN tu ON tu.id = harm_id JOIN seat ON seat.id = safe_id"""


_HARD = f"""WITH RECURSIVE {POOL}, hc AS (SELECT primary_category AS category, count(*) AS available FROM pool WHERE label = 'harm' GROUP BY 1), {pl.allocated_sql("hc", wanted="least(100, sum(available) OVER ())")},
hs AS (SELECT id, prompt FROM (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY {hashed_sql("id")}, id) AS rn FROM pool WHERE label = 'harm') JOIN al ON primary_category = category WHERE rn <= taken),
tu AS (SELECT id, row_number() OVER (ORDER BY {hashed_sql("id")}, id) AS turn FROM hs), sf AS (SELECT id, prompt FROM pool WHERE label = 'safe'),
bx AS (SELECT id, list_filter({_TOK.replace("text", "prompt")}, lambda w: w NOT IN {STOP}) AS w FROM (SELECT * FROM hs UNION ALL SELECT * FROM sf)),
{_tfidf_sql("bx", "id", True, found="unnest(w)")},
sm AS (SELECT a.id AS a, b.id AS b, round(sum(a.weight * b.weight), 6) AS score FROM wt a JOIN hs ON hs.id = a.id JOIN wt b ON a.term = b.term JOIN sf ON sf.id = b.id GROUP BY ALL),
wish AS (SELECT tu.turn, tu.id AS a, sf.id AS b, CASE WHEN score >= 0.95 THEN -1.0 ELSE coalesce(score, 0.0) END AS score FROM tu CROSS JOIN sf LEFT JOIN sm ON sm.a = tu.id AND sm.b = sf.id),
m AS (SELECT 0::BIGINT AS turn, NULL::BIGINT AS harm_id, NULL::BIGINT AS safe_id, []::BIGINT[] AS used
UNION ALL SELECT turn, harm_id, safe_id, CASE WHEN safe_id IS NULL THEN used ELSE list_append(used, safe_id) END FROM
(SELECT tu.turn, tu.id AS harm_id, (SELECT arg_min(wish.b, (-wish.score, wish.b)) FROM wish WHERE wish.turn = m.turn + 1 AND NOT list_contains(m.used, wish.b)) AS safe_id, m.used FROM m JOIN tu ON tu.turn = m.turn + 1))
SELECT harm_id, safe_id, CAST(wish.score AS DOUBLE) AS score FROM m JOIN wish ON wish.a = harm_id AND wish.b = safe_id"""
_ELIGIBLE = f" WHERE chars <= 1000 AND NOT regexp_matches(prompt, '(?i){_JB}')"

ORACLE_SQL = {
    "tfidf_weights": f"WITH {POOL}, bx AS (SELECT id, prompt AS text FROM pool), {_tfidf_sql('bx', 'id', False)} SELECT id, term, round(weight, 6) AS weight FROM wt",
    "tfidf_paraphrase": f"WITH {POOL}, px AS (SELECT id, label, coalesce(primary_category, '') AS category, prompt AS text FROM pool), {_pairs_sql('px', 'label, category', '1', 0.35, 0.95)} SELECT label, category, a, b, score FROM sm1",
    "paraphrase_allocated": f"""WITH {POOL}, px AS (SELECT id, primary_category, prompt AS text FROM pool WHERE label = 'harm'), sx AS (SELECT id, '' AS grp, prompt AS text FROM pool WHERE label = 'safe'),
{_pairs_sql("px", "primary_category", "1", 0.2, 0.95)}, {_pairs_sql("sx", "grp", "2", 0.2, 0.95)},
hc AS (SELECT primary_category AS category, count(*) AS available FROM sm1 GROUP BY 1), {pl.allocated_sql("hc", wanted="least(200, sum(available) OVER ())")},
ch AS (SELECT primary_category, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY {hashed_sql(_PAIR_KEY)}, {_PAIR_KEY}) AS rn FROM sm1) JOIN al ON primary_category = category WHERE rn <= taken)
SELECT * FROM ch UNION ALL SELECT NULL, a, b, score FROM (SELECT *, row_number() OVER (ORDER BY {hashed_sql(_PAIR_KEY)}, {_PAIR_KEY}) AS rn FROM sm2) WHERE rn <= 400 - (SELECT count(*) FROM ch)""",
    "neardup_anti": f"""WITH bt AS (SELECT -1 - item_id AS id, {_COLLAPSED} AS text FROM benchmark WHERE text IS NOT NULL), dt AS (SELECT doc_id AS id, {_COLLAPSED} AS text FROM documents WHERE text IS NOT NULL),
bw AS (SELECT id, {_TOK} AS w FROM (SELECT * FROM bt UNION ALL SELECT * FROM dt)),
{_tfidf_sql("bw", "id", True, found=_GRAMS)},
sm AS (SELECT a.id AS a FROM wt a JOIN wt b ON a.term = b.term AND a.id >= 0 AND b.id < 0 GROUP BY a.id, b.id HAVING round(sum(a.weight * b.weight), 6) >= 0.9)
SELECT id FROM dt WHERE id NOT IN (SELECT a FROM sm) AND text NOT IN (SELECT text FROM bt)""",
    "hard_negatives": _HARD,
    "length_matched_wraps": _matched_sql(_ELIGIBLE, "true", "abs(seat.chars - tu.chars)"),
    "length_match_range": _matched_sql("", "seat.chars >= tu.chars * 0.75::DOUBLE AND seat.chars <= tu.chars * 1.25::DOUBLE", "seat.chars"),
    "l2_normalize": f"WITH {_Z} SELECT id, round(sqrt(list_dot_product(z, z)), 6) AS norm, round(z[1], 6) AS first FROM z",
    "describe_embeddings": f"WITH {_Z} SELECT label, max(len(e)) AS dim, count(*) AS n, round(avg(nrm), 6) AS mean_norm, round(stddev_samp(nrm), 6) AS std_norm_samp, round(quantile_cont(nrm, 0.25), 6) AS q25, round(quantile_cont(nrm, 0.5), 6) AS q50, round(quantile_cont(nrm, 0.75), 6) AS q75 FROM z GROUP BY label",
    "class_centroids": f"WITH {_Z} SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(z[i]), 6) AS mean FROM z, range(1, 65) r(i) GROUP BY label, i",
    "centroid_scores": f"WITH {_Z}, {_CENTERS} SELECT id, round(list_dot_product(z, h.c) / h.nc - list_dot_product(z, s.c) / s.nc, 6) AS score FROM z, (SELECT * FROM cv WHERE y = 1) h, (SELECT * FROM cv WHERE y = 0) s",
    "knn_topk": f"WITH {_Z}, {_NN.format(10)} SELECT q, b, round(cos, 6) AS cos, rank FROM nn",
    "knn_classify": f"""WITH {_Z}, {_NN.format(25)}, f AS (SELECT *, row_number() OVER (PARTITION BY q, b % 50 ORDER BY rank) AS g FROM nn), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS place FROM f WHERE g = 1)
SELECT q, round(sum((greatest(cos, 0) + 1e-6::DOUBLE) * yb) / sum(greatest(cos, 0) + 1e-6::DOUBLE), 6) AS score FROM p WHERE place <= 5 GROUP BY q""",
    "knn_diff": f"""WITH {_Z}, c AS (SELECT a.id AS q, b.id AS b, b.y AS side, round(list_dot_product(a.z, b.z), 9) AS cos FROM z a JOIN z b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q, side ORDER BY cos DESC, b) AS rk FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, b) AS ra FROM r WHERE rk <= 5)
SELECT q, round(avg(cos) FILTER (side = 1) - avg(cos) FILTER (side = 0), 6) AS knn_diff, round(1 - max(cos) FILTER (ra = 5), 6) AS ood_knn FROM t GROUP BY q""",
    "geometry_metrics": f"""WITH {_Z}, {_NN.format(10)}, c AS (SELECT a.y AS ya, b.y AS yb, list_dot_product(a.z, b.z) AS cos FROM z a JOIN z b ON a.id <> b.id)
SELECT round(avg(cos), 6) AS mean_cos, round(avg(2 - 2 * cos) FILTER (ya = yb) / avg(2 - 2 * cos), 6) AS alignment, (SELECT round(avg(CASE WHEN z.y = nn.yb THEN 1.0::DOUBLE ELSE 0 END), 6) FROM nn JOIN z ON z.id = nn.q) AS knn_purity, round(ln(avg(exp(-2 * greatest(2 - 2 * cos, 0)))), 6) AS uniformity,
(SELECT round(pow(sum(cov) FILTER (i = j), 2) / sum(cov * cov), 4) FROM (SELECT i, j, covar_samp(e[i], e[j]) AS cov FROM z, range(1, 65) p(i), range(1, 65) q(j) GROUP BY i, j)) AS participation FROM c""",
    "category_purity": f"WITH {_Z}, {_NN.format(10)} SELECT (SELECT round(avg(CASE WHEN z.label = nn.bl THEN 1.0::DOUBLE ELSE 0 END), 6) FROM nn JOIN z ON z.id = nn.q) AS purity, (SELECT round(sum(p * p), 6) FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM z) AS p FROM z GROUP BY label)) AS chance",
    "embedding_covariance": "WITH e AS (SELECT embedding::DOUBLE[] AS e FROM embeddings) SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(covar_samp(e[i], e[j]), 6) AS cov FROM e, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j",
    "half_split_distance": f"WITH {_Z}, {_HALF}, p AS (SELECT a.round, list_dot_product(a.z, b.z) AS cos FROM hv a JOIN hv b ON a.round = b.round AND a.place = b.place AND a.half = 0 AND b.half = 1) SELECT CAST(round AS INTEGER) AS round, round(avg(1 - cos), 6) AS cos_distance, round(avg(sqrt(greatest(2 - 2 * cos, 0))), 6) AS l2_distance FROM p GROUP BY p.round",
    "distance_ratio": f"""WITH {_Z}, {_CENTERS}, {_HALF}, p AS (SELECT a.round, list_dot_product(a.z, b.z) AS cos FROM hv a JOIN hv b ON a.round = b.round AND a.place = b.place AND a.half = 0 AND b.half = 1),
w AS (SELECT avg(c) AS w FROM (SELECT round(avg(1 - cos), 6) AS c FROM p GROUP BY p.round)), b AS (SELECT 1 - list_dot_product(h.c, s.c) / (h.nc * s.nc) AS b FROM (SELECT * FROM cv WHERE y = 1) h, (SELECT * FROM cv WHERE y = 0) s)
SELECT round(b, 6) AS between, round(w, 6) AS within, round(b / w, 4) AS ratio FROM w, b""",
    "ari_contingency": """WITH x AS (SELECT label, CASE WHEN embedding[1] > 0 THEN 4 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[3] > 0 THEN 1 ELSE 0 END AS cluster FROM embeddings),
c AS (SELECT label, cluster, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), a AS (SELECT sum(m * (m - 1) / 2) AS a FROM (SELECT sum(n) AS m FROM c GROUP BY label)), b AS (SELECT sum(m * (m - 1) / 2) AS b FROM (SELECT sum(n) AS m FROM c GROUP BY cluster))
SELECT round((s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM s, a, b""",
    "twin_hit_at_k": f"""WITH {_Z}, {_NN.format(10)}, t AS (SELECT id AS q, lead(id) OVER (PARTITION BY label ORDER BY id) AS twin FROM z), h AS (SELECT q, min(CASE WHEN b = twin THEN rank END) AS found FROM t JOIN nn USING (q) WHERE twin IS NOT NULL GROUP BY q)
SELECT count(*) AS queries, round(avg(CASE WHEN found <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN found <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN found <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_10 FROM h""",
    "collapse_rules": f"""WITH {_Z}, m AS (SELECT a.label, avg(list_dot_product(a.z, b.z)) AS mc FROM z a JOIN z b ON a.label = b.label AND a.id <> b.id GROUP BY a.label), r AS (SELECT mc AS ref FROM m WHERE label = 0)
SELECT label, round(mc, 6) AS mean_cos, round(greatest(0.05, (1 + ref) / 2), 6) AS "limit", CASE WHEN mc > greatest(0.05, (1 + ref) / 2) THEN 'mean_cos' ELSE '' END AS reasons FROM m, r""",
    "supcon_loss": f"""WITH {_Z}, bt AS (SELECT id, label, z, CAST(floor({uniform_sql("id", "b")} * 1000000) AS BIGINT) % greatest(1, (SELECT (count(*) + 31) // 32 FROM z)) AS batch FROM z),
p AS (SELECT a.batch, a.id AS i, CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0 END AS w, list_dot_product(a.z, b.z) / 0.1::DOUBLE AS l FROM bt a JOIN bt b ON a.batch = b.batch AND a.id <> b.id),
q AS (SELECT batch, i, w, l - ln(sum(exp(l)) OVER (PARTITION BY batch, i)) AS lp FROM p), r AS (SELECT batch, i, -sum(w * lp) / nullif(sum(w), 0) AS loss FROM q GROUP BY 1, 2 HAVING sum(w) > 0)
SELECT batch, round(avg(loss), 6) AS loss, count(*) AS anchors FROM r GROUP BY batch""",
}

QUERIES = {
    f.__name__: f for f in (
        tfidf_weights, tfidf_paraphrase, paraphrase_allocated, neardup_anti, hard_negatives, length_matched_wraps, length_match_range,
        l2_normalize, describe_embeddings, class_centroids, centroid_scores, knn_topk, knn_classify, knn_diff, geometry_metrics,
        category_purity, embedding_covariance, pca_components, pca_overlap, half_split_distance, distance_ratio, ari_contingency,
        kmeans_ari, twin_hit_at_k, collapse_rules, supcon_loss
    )
}
