"""Contrastive pairs of prompts: random, wrapped, matched, similar; their manifests."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import hashed
from .pool import ranked, shuffled

#: Neutral wrappers; some have a placeholder for the request, one has none.
TEMPLATES = (
    "Please consider the following text: {0}",
    "Read this carefully.",
    "Text: {0}\nEnd of text. Again: {0}",
    "A colleague wrote:",
    "Summary task. {0}",
)
#: A small bank of neutral code-domain texts: two phrasings on each side of a topic.
BANK = (
    ("archives", ("unpack every archive at once", "unpack archives without checks"), ("unpack one archive safely", "check an archive before unpacking")),
    ("network", ("scan all hosts without asking", "send packets to every host"), ("scan my own host", "measure the delay to my own host")),
)


def templates(spark, texts: tuple[str, ...] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "template_id int, template string")


def template_literals(source: str) -> tuple[str, ...]:
    """The strings of the longest list literal in Python source, read and not run."""
    import ast

    lists = [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.List)]
    found = [[e.value for e in n.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)] for n in lists]
    return tuple(max(found, key=len, default=[]))


def bank(spark, entries=BANK) -> DataFrame:
    return spark.createDataFrame(list(entries), "category string, malicious array<string>, benign_twin array<string>")


def random_pairs(df: DataFrame, n: int, label: str = "label", key: str = "id", seed: int = 42) -> DataFrame:
    """(position, harm_id, safe_id): the i-th of either label in random order; n pairs at most."""
    x = shuffled(df.select(key, label), [label], key, seed, "position").where(F.col("position") <= n)
    return x.groupBy("position").agg(
        F.max(F.when(F.col(label) == "harm", F.col(key))).alias("harm_id"),
        F.max(F.when(F.col(label) == "safe", F.col(key))).alias("safe_id")
    ).where("harm_id IS NOT NULL AND safe_id IS NOT NULL")


def wraps(
    df: DataFrame, tmpl: DataFrame, k: int, text: str = "prompt", key: str = "id", seed: int = 42, context: str | None = None,
    substitute: bool = True
) -> DataFrame:
    """Each text in k templates at random: adds template_id and wrapped.

    The templates are few, so their product with the texts is taken in place and cut to k per
    text without a shuffle. With ``context`` the request is preceded by it; without
    ``substitute`` the request is always appended, as in the first version of the builder.
    """
    request = F.col(text)
    if context:
        c = F.col(context)
        request = F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit("\n\n---\n\n"), request)).otherwise(request)
    bank_of = F.broadcast(tmpl.agg(F.collect_list(F.struct("template_id", "template")).alias("all ")))
    order = F.transform(
        "all ",
        lambda t: F.struct(
            hashed(F.concat_ws(":", F.col(key).cast("string"), t["template_id"].cast("string")), seed).alias("h"),
            t["template_id"].alias("template_id"), t["template"].alias("template")
        )
    )
    x = df.crossJoin(bank_of).withColumn("t ", F.explode(F.slice(F.array_sort(order), 1, k)))
    t = F.col("t ").getField("template")
    body = X.wrapped(t, request) if substitute else F.concat(t, F.lit("\n\n"), request)
    return x.withColumn("template_id", F.col("t ").getField("template_id")).withColumn("wrapped", body).drop("t ", "all ")


def code_contrast(b: DataFrame) -> DataFrame:
    """Every malicious text with every benign one of its topic."""
    x = b.select("category", F.posexplode("malicious").alias("harm_index", "harm_text"), "benign_twin")
    return x.select("category", "harm_index", "harm_text", F.posexplode("benign_twin").alias("safe_index", "safe_text"))


def code_paraphrase(b: DataFrame) -> DataFrame:
    """Pairs i < j of the texts of one side of a topic."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("malicious").alias("kind"), F.col("malicious").alias("texts")),
            F.struct(F.lit("benign_twin").alias("kind"), F.col("benign_twin").alias("texts"))
        )
    ).alias("s")
    x = b.select("category", sides).select("category", "s.kind", "s.texts", F.posexplode("s.texts").alias("first", "first_text"))
    return x.select("category", "kind", "first", "first_text", F.posexplode("texts").alias("second", "second_text")).where("first < second")


def code_wrapped(b: DataFrame, tmpl: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Parallel texts of a topic in the same templates: one row per (topic, index, template)."""
    z = b.select("category", F.posexplode(F.arrays_zip("malicious", "benign_twin")).alias("index", "z"))
    z = z.select(
        "category", "index", F.col("z.malicious").alias("malicious"), F.col("z.benign_twin").alias("benign")
    ).where("malicious IS NOT NULL AND benign IS NOT NULL")
    z = z.withColumn("key", F.concat_ws(":", "category", F.col("index").cast("string")))
    x = wraps(z, tmpl, k, "malicious", "key", seed).withColumnRenamed("wrapped", "harm_wrapped").join(F.broadcast(tmpl), "template_id")
    return x.withColumn("safe_wrapped", X.wrapped(F.col("template"), F.col("benign"))).select(
        "category", "index", "template_id",
        F.concat_ws(":", F.lit("code_bank"), "category", F.lit("malicious"), F.col("index").cast("string")).alias("source_id"),
        "harm_wrapped", "safe_wrapped"
    )


def side_counts(pairs: DataFrame, category: Column, empty: str) -> DataFrame:
    """Pairs by type and category; null and empty categories under ``empty``."""
    return pairs.groupBy(
        "pair_type", F.coalesce(F.nullif(category, F.lit("")), F.lit(empty)).alias("category")
    ).agg(F.count("*").alias("n"))


def unpivoted(pairs: DataFrame) -> DataFrame:
    """One row per side: (pair_id, side, text, label, category); anchors come before partners."""
    def side(name: str, order: int) -> DataFrame:
        return pairs.select(
            "pair_id", F.lit(order).alias("side"), F.col(f"{name}_text").alias("text"), F.col(f"{name}_label").alias("label"),
            F.col(f"{name}_category").alias("category")
        )

    return side("anchor", 0).unionByName(side("pair", 1))


def matched_by_length(left: DataFrame, right: DataFrame, choose, seed: int | str = 42) -> DataFrame:
    """(left id, right id, their lengths): each row of left, in random order, gets an unused row of right.

    Both sides are (id, chars). Each choice depends on all before it, so one task goes through the left ids and
    lengths in order; it holds only how many rows of right are left of each length (lengths of prompts are
    bounded by the pool's filters), and ``choose`` names a length. Rows of right of one length go
    in random order, found by a join on length and number.
    """
    stock = {r[0]: r[1] for r in right.groupBy("chars").agg(F.count("*")).collect()}  # one row a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, used = dict(stock), dict.fromkeys(stock, 0)
        live = sorted(have)
        for batch in batches:
            rows = []
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = choose(live, n)
                if found is None:
                    continue
                used[found] += 1
                if used[found] == have[found]:
                    live.remove(found)
                rows.append((i, n, found, used[found]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["left_id", "left_chars", "chars", "number"])

    turns = left.select(
        "id", F.col("chars").cast("long"), hashed(F.col("id"), seed).alias("turn")
    ).repartition(1).sortWithinPartitions("turn", "id").select("id", "chars")
    found = turns.mapInArrow(run, "left_id long, left_chars long, chars long, number long")
    numbered = shuffled(right.select("id", F.col("chars").cast("long")), ["chars"], "id", seed, "number")
    return found.join(numbered, ["chars", "number"]).select(
        "left_id", F.col("id").alias("right_id"), "left_chars", F.col("chars").alias("right_chars")
    )


def nearest(live: list[int], n: int) -> int | None:
    """The length of ``live`` (sorted) nearest to n; of two as near the shorter."""
    i = bisect.bisect_left(live, n)
    return min(live[max(0, i - 1) : i + 1], key=lambda x: (abs(x - n), x), default=None)


def shortest_within(tolerance: float):
    """The shortest length of ``live`` within the tolerance of n."""

    def choose(live: list[int], n: int) -> int | None:
        i = bisect.bisect_left(live, n * (1 - tolerance))
        return live[i] if i < len(live) and live[i] <= n * (1 + tolerance) else None

    return choose


def matched_by_score(left: DataFrame, right: DataFrame, scores: DataFrame, n: int, most: float = 0.95, seed: int | str = 42) -> DataFrame:
    """(left_id, right_id, score): n rows of left at most, in random order, each with its most similar unused row of right.

    ``scores`` has the pairs (a, b, score) above zero. Rows of right that are not in them have 0, near duplicates
    (``most`` and more) -1; ties go to the smaller id. Of n rows only the n best partners of each matter,
    and where those run out the smallest ids, so what one task settles is bounded by the parameter n and the near duplicates.

    A partner keeps the earliest row that asks for it and a row that loses its partner asks the next of its list:
    the outcome is the one of choosing in turn, in whatever order the asking happens.
    """
    # n rows
    turns = left.select("id").orderBy(hashed(F.col("id"), seed), "id").limit(n).withColumn(
        "turn", F.row_number().over(Window.orderBy(hashed(F.col("id"), seed), "id"))
    )
    mine = scores.join(F.broadcast(turns), F.col("a") == F.col("id")).select(
        "turn", "a", "b", F.when(F.col("score") >= most, -1.0).otherwise(F.col("score")).alias("score")
    )
    best = ranked(mine.where("score > 0"), ["turn"], [F.col("score").desc(), F.col("b")], "place").where(F.col("place") <= n)
    refused = mine.where("score < 0")
    spare = n + (
        best.unionByName(refused, allowMissingColumns=True).groupBy("turn").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    )
    first = right.select(F.col("id").alias("b")).orderBy("b").limit(spare)
    rows = best.drop("place").unionByName(refused).unionByName(first, allowMissingColumns=True).unionByName(
        turns.withColumnRenamed("id", "a"), allowMissingColumns=True
    )

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        names = dict(rows[rows.b.isna()][["turn", "a"]].astype("int64").itertuples(index=False))
        spares = sorted(rows[rows.turn.isna()].b.astype("int64"))
        liked: dict[int, list] = {t: [] for t in names}
        for t, b, score in rows.dropna(subset=["turn", "b"])[["turn", "b", "score"]].itertuples(index=False):
            liked[int(t)].append((-score, int(b)))

        def wishes(turn: int) -> Iterator[tuple[float, int]]:
            scored = sorted(liked[turn])
            known = {b for _, b in scored}
            yield from ((-s, b) for s, b in scored if s < 0)
            yield from ((0.0, b) for b in spares if b not in known)
            yield from ((-s, b) for s, b in scored if s > 0)

        asks, held = {t: wishes(t) for t in names}, {}
        waiting = list(names)
        while waiting:
            turn = waiting.pop()
            for score, b in asks[turn]:
                if b not in held or held[b][0] > turn:
                    waiting += [held[b][0]] if b in held else []
                    held[b] = (turn, score)
                    break
        return pd.DataFrame([(names[t], b, s) for b, (t, s) in held.items()], columns=["left_id", "right_id", "score"])

    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(settle, "left_id long, right_id long, score double")
