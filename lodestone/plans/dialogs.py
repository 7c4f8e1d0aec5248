"""Queries on dialogs and run logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import pool as pl
from ..sources.tables import DIALOGS, RUNS, dialogs, hashed_sql, runs

#: Dialogs of the red side have an odd id; ratings and authors are derived from the id.
RED = "dialog_id % 2 = 1"


def _frame(s, d) -> DataFrame:
    return dialogs(s, d).select(
        "dialog_id", "turns", F.size("turns").alias("n_turns"), F.element_at("turns", 1).alias("first_turn"),
        F.element_at("turns", -1).alias("last_turn"), F.array_join("turns", "\n").alias("human_side"),
        (F.col("dialog_id") % 5).cast("int").alias("rating"),
        F.concat(F.lit("author-"), (F.col("dialog_id") % 13).cast("string")).alias("author")
    )


_F = f"""{DIALOGS}, fr AS (SELECT dialog_id, turns, CAST(len(turns) AS INTEGER) AS n_turns, turns[1] AS first_turn, turns[-1] AS last_turn, array_to_string(turns, chr(10)) AS human_side, CAST(dialog_id % 5 AS INTEGER) AS rating, 'author-' || (dialog_id % 13) AS author FROM dialogs)"""


def _variants(s, d) -> DataFrame:
    """Turns 1 to 3, contexts of 2 and 3 turns, the last turn and the whole human side."""
    f = _frame(s, d)
    v = [F.struct(F.lit(f"turn {k}").alias("variant"), F.get("turns", F.lit(k - 1)).alias("text")) for k in (1, 2, 3)]
    v += [
        F.struct(
            F.lit(f"context {k}").alias("variant"), F.when(F.col("n_turns") >= k, F.array_join(F.slice("turns", 1, k), "\n")).alias("text")
        ) for k in (2, 3)
    ]
    v += [
        F.struct(F.lit("last turn").alias("variant"), F.col("last_turn").alias("text")),
        F.struct(F.lit("human side").alias("variant"), F.col("human_side").alias("text"))
    ]
    return f.select("dialog_id", F.explode(F.array(*v)).alias("v")).select("dialog_id", "v.variant", "v.text").where("text IS NOT NULL")


_V = f"""{_F}, vr AS (SELECT dialog_id, 'turn 1' AS variant, turns[1] AS text FROM fr UNION ALL SELECT dialog_id, 'turn 2', turns[2] FROM fr UNION ALL SELECT dialog_id, 'turn 3', turns[3] FROM fr
UNION ALL SELECT dialog_id, 'context 2', array_to_string(turns[1:2], chr(10)) FROM fr WHERE n_turns >= 2 UNION ALL SELECT dialog_id, 'context 3', array_to_string(turns[1:3], chr(10)) FROM fr WHERE n_turns >= 3
UNION ALL SELECT dialog_id, 'last turn', last_turn FROM fr UNION ALL SELECT dialog_id, 'human side', human_side FROM fr),
sv AS (SELECT dialog_id, variant, text, (length(text) % 101)::DOUBLE AS score FROM vr WHERE text IS NOT NULL)"""


def _scored(s, d):
    """A deterministic score of every variant, from its length."""
    return _variants(s, d).withColumn("score", (F.char_length("text") % 101).cast("double"))


def dialog_frame(s, d):
    return _variants(s, d).select("dialog_id", "variant", F.char_length("text").alias("chars"))


def dialog_first_turns(s, d):
    """A sample of 20 first turns of either side: 10 chars or more, not shared by both sides, one dialog a text."""
    f = _frame(s, d).withColumn("side", F.when(F.expr(RED), "red").otherwise("help"))
    shared = f.where("side = 'red'").select("first_turn").intersect(f.where("side = 'help'").select("first_turn"))
    x = f.where("char_length(first_turn) >= 10").join(shared, "first_turn", "left_anti")
    x = pl.ranked(x, ["side", "first_turn"], F.col("dialog_id"), "rn").where("rn = 1").drop("rn")
    return pl.sample(x.select("side", "dialog_id"), 20, "dialog_id", ["side"])


def dialog_rating_cells(s, d):
    """Red dialogs outside the first-turn sample, one per human side, at most 20 of each rating at random."""
    red = _frame(s, d).where(RED).join(dialog_first_turns(s, d).where("side = 'red'").select("dialog_id"), "dialog_id", "left_anti")
    x = pl.ranked(red, ["rating", "human_side"], F.col("dialog_id"), "rn").where("rn = 1")
    return pl.sample(x.select("rating", "dialog_id"), 20, "dialog_id", ["rating"])


def dialog_escalation(s, d):
    """AUROC of red against help by variant, and the share of dialogs whose last turn outscores the first."""
    x = _scored(s, d).withColumn("y", F.when(F.expr(RED), 1).otherwise(0))
    a = M.auroc(x, "score", "y", ["variant"]).select("variant", F.round("auroc", 6).alias("auroc"))
    two = x.where("variant IN ('turn 1', 'last turn')").groupBy("dialog_id").agg(
        F.max(F.when(F.col("variant") == "turn 1", F.col("score"))).alias("f"),
        F.max(F.when(F.col("variant") == "last turn", F.col("score"))).alias("l")
    )
    up = two.agg(F.round(F.avg((F.col("l") > F.col("f")).cast("double")), 6).alias("last_over_first"))
    return a.crossJoin(F.broadcast(up))


def position_zscore(s, d):
    """Scores by variant in units of the help side's first turns: mean and half of the 95 % interval."""
    x = _scored(s, d)
    ref = x.where(f"variant = 'turn 1' AND NOT ({RED})").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))
    z = x.crossJoin(F.broadcast(ref)).withColumn("z", (F.col("score") - F.col("m")) / F.col("sd"))
    return z.groupBy("variant").agg(
        F.round(F.avg("z"), 6).alias("mean"), F.round(1.96 * F.stddev_samp("z") / F.sqrt(F.count("*").cast("double")), 6).alias("half")
    )


def _out_of_fold(x: DataFrame, feature: str, folds: int = 3) -> DataFrame:
    """Adds wrong_<feature>: whether the class whose mean is nearer, both taken from the other folds, is not the row's."""
    of = lambda y: [F.sum(F.when(F.col("y") == y, F.col(feature))).alias(f"s{y}"), F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}")]
    sums = x.groupBy("fold").agg(*of(0), *of(1))  # one row a fold
    others = sums.crossJoin(F.broadcast(sums.select(F.col("fold").alias("out")))).where("fold <> out").groupBy("out").agg(
        *[(F.sum(f"s{y}") / F.sum(f"n{y}")).alias(f"m{y}") for y in (0, 1)]
    )
    j = x.join(F.broadcast(others), F.col("fold") == F.col("out"))
    near = (F.abs(F.col(feature) - F.col("m1")) < F.abs(F.col(feature) - F.col("m0"))).cast("int")
    return j.withColumn(f"wrong_{feature}", (near != F.col("y")).cast("int")).drop("out", "m0", "m1")


def review_verdicts(s, d):
    """Verdicts of two out-of-fold scorers on the union of both sides (missing columns null), summed by verdict.

    The scorers tell the sides by the length of the first turn and of the whole human side; a fold is judged by the means of the other folds.
    """
    f = _frame(s, d).withColumn("whole", F.char_length("human_side"))
    red = f.where(RED).select(F.lit("red").alias("source"), "dialog_id", "n_turns", "first_turn", "whole", "rating", "author")
    both = red.unionByName(
        f.where(f"NOT ({RED})").select(F.lit("help").alias("source"), "dialog_id", "n_turns", "first_turn", "whole"),
        allowMissingColumns=True
    )
    x = both.withColumn("y", (F.col("source") == "red").cast("int")).withColumn("chars", F.char_length("first_turn"))
    x = _out_of_fold(_out_of_fold(pl.folds_by_label(x, 3, "y", "dialog_id"), "chars"), "whole")
    wrong = F.col("wrong_chars") + F.col("wrong_whole")
    x = x.withColumn("verdict", F.when(wrong >= 2, "missed").when(wrong == 0, "clear").otherwise("disputed")).where("source = 'red'")
    return x.groupBy("verdict").agg(
        F.count("*").alias("n"), F.count_distinct("author").alias("authors"), F.median("n_turns").alias("median_turns"),
        F.round(F.avg((F.col("rating") == 0).cast("double")), 6).alias("share_rating_0"), F.median("chars").alias("median_chars")
    )


def author_concentration(s, d):
    c = _frame(s, d).groupBy("author").agg(F.count("*").alias("n"))
    top = c.orderBy(F.col("n").desc(), "author").limit(5).agg(F.sum("n").alias("top5"), F.max("n").alias("top"))
    every = c.agg(F.sum("n").alias("n"), F.count("*").alias("authors"))
    return every.crossJoin(F.broadcast(top)).select(
        "n", "authors", F.round(F.col("top") / F.col("n"), 6).alias("top_share"), F.round(F.col("top5") / F.col("n"), 6).alias("top5_share")
    )


def runlog_outer_join(s, d):
    """Training steps with the evaluations at them, full outer; finite values only."""
    r = runs(s, d)
    e = r.where("step % 10 = 0").select("variant", "seed", (F.col("step") + 5).alias("step"), (F.col("loss") * 2).alias("eval/loss"))
    x = r.withColumnRenamed("loss", "train/loss").join(e, ["variant", "seed", "step"], "full_outer")
    fin = lambda c: F.when(~F.isnan(F.col(f"`{c}`")) & (F.abs(F.col(f"`{c}`")) < float("inf")), F.round(F.col(f"`{c}`"), 6)).alias(c)
    return x.select("variant", "seed", "step", fin("train/loss"), fin("eval/loss"))


def runlog_curve(s, d):
    r = runs(s, d)
    n = r.agg(F.count_distinct("variant", "seed").alias("runs"))
    x = r.groupBy("step").agg(
        F.round(F.avg("loss"), 6).alias("mean"), F.round(F.min("loss"), 6).alias("low"), F.round(F.max("loss"), 6).alias("high")
    )
    return x.crossJoin(F.broadcast(n))


def rolling_loss(s, d, rows: int = 10, run: int = 10_000):
    """Mean of the last ten losses of each run. A task has ``run`` steps, and of the steps before them those that its first means need."""
    x = runs(s, d).withColumn("part", F.floor((F.col("step") - 1) / run))
    last = F.pmod(F.col("step") - 1, F.lit(run)) > run - rows
    parts = F.when(last, F.array("part", F.col("part") + 1)).otherwise(F.array("part"))
    x = x.withColumn("own", F.col("part")).withColumn("part", F.explode(parts))
    w = Window.partitionBy("variant", "seed", "part").orderBy("step").rowsBetween(1 - rows, Window.currentRow)
    return x.withColumn("rolling", F.round(F.avg("loss").over(w), 6)).where("part = own").select("variant", "seed", "step", "rolling")


def early_stop(s, d, every: int = 10, patience: int = 5, delta: float = 0.001):
    """Where each run would stop: evaluations every ten steps, a patience counter with a least gain."""
    r = runs(s, d).where(F.col("step") % every == 0).select("variant", "seed", "step", "loss")

    def stop(pdf: pd.DataFrame) -> pd.DataFrame:
        best, at, waits, end = float("inf"), 0, 0, int(pdf["step"].max())
        for row in pdf.sort_values("step").itertuples():
            if row.loss < best - delta:
                best, at, waits = row.loss, row.step, 0
            else:
                waits += 1
            if waits >= patience:
                end = row.step
                break
        return pd.DataFrame(
            [(pdf["variant"].iloc[0], pdf["seed"].iloc[0], at, end, round(best, 6))],
            columns=["variant", "seed", "best_step", "stop_step", "best_loss"]
        )

    return r.groupBy("variant", "seed").applyInPandas(stop, "variant string, seed long, best_step int, stop_step int, best_loss double")


_FIRST = f"""{_F}, sh AS (SELECT first_turn FROM fr WHERE {RED} INTERSECT SELECT first_turn FROM fr WHERE NOT ({RED})),
ft AS (SELECT CASE WHEN {RED} THEN 'red' ELSE 'help' END AS side, first_turn, min(dialog_id) AS dialog_id FROM fr WHERE length(first_turn) >= 10 AND first_turn NOT IN (SELECT first_turn FROM sh) GROUP BY 1, 2),
fs AS (SELECT side, dialog_id FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {hashed_sql('dialog_id')}, dialog_id) AS rn FROM ft) WHERE rn <= 20)"""
_AUC = "(SELECT variant, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY variant ORDER BY score) + (count(*) OVER (PARTITION BY variant, score) - 1) / 2.0::DOUBLE AS rk FROM ys) GROUP BY variant)"
ORACLE_SQL = {
    "dialog_frame": f"WITH {_V} SELECT dialog_id, variant, length(text) AS chars FROM sv",
    "dialog_first_turns": f"WITH {_FIRST} SELECT side, dialog_id FROM fs",
    "dialog_rating_cells": f"""WITH {_FIRST}, rd AS (SELECT rating, human_side, min(dialog_id) AS dialog_id FROM fr WHERE {RED} AND dialog_id NOT IN (SELECT dialog_id FROM fs WHERE side = 'red') GROUP BY 1, 2)
SELECT rating, dialog_id FROM (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {hashed_sql('dialog_id')}, dialog_id) AS rn FROM rd) WHERE rn <= 20""",
    "dialog_escalation": f"""WITH {_V}, ys AS (SELECT *, CASE WHEN {RED} THEN 1 ELSE 0 END AS y FROM sv), tw AS (SELECT dialog_id, max(score) FILTER (variant = 'turn 1') AS f, max(score) FILTER (variant = 'last turn') AS l FROM sv GROUP BY 1)
SELECT variant, round(auroc, 6) AS auroc, (SELECT round(avg(CASE WHEN l > f THEN 1.0::DOUBLE ELSE 0 END), 6) FROM tw) AS last_over_first FROM {_AUC}""",
    "position_zscore": f"""WITH {_V}, rf AS (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM sv WHERE variant = 'turn 1' AND NOT ({RED}))
SELECT variant, round(avg((score - m) / sd), 6) AS mean, round(1.96 * stddev_samp((score - m) / sd) / sqrt(count(*)), 6) AS half FROM sv, rf GROUP BY variant""",
    "review_verdicts": f"""WITH {_F}, x AS (SELECT *, CASE WHEN {RED} THEN 1 ELSE 0 END AS y, length(first_turn) AS chars, length(human_side) AS whole, (row_number() OVER (PARTITION BY dialog_id % 2 ORDER BY {hashed_sql('dialog_id')}, dialog_id) - 1) % 3 AS fold FROM fr),
o AS (SELECT f.o AS out, avg(chars) FILTER (y = 0) AS c0, avg(chars) FILTER (y = 1) AS c1, avg(whole) FILTER (y = 0) AS w0, avg(whole) FILTER (y = 1) AS w1 FROM x, range(0, 3) f(o) WHERE fold <> f.o GROUP BY f.o),
v AS (SELECT x.*, (CASE WHEN abs(chars - c1) < abs(chars - c0) THEN 1 ELSE 0 END <> y)::INT + (CASE WHEN abs(whole - w1) < abs(whole - w0) THEN 1 ELSE 0 END <> y)::INT AS wrong FROM x JOIN o ON fold = out WHERE y = 1)
SELECT CASE WHEN wrong >= 2 THEN 'missed' WHEN wrong = 0 THEN 'clear' ELSE 'disputed' END AS verdict, count(*) AS n, count(DISTINCT author) AS authors, median(n_turns) AS median_turns, round(avg(CASE WHEN rating = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_rating_0, median(chars) AS median_chars FROM v GROUP BY 1""",
    "author_concentration": f"WITH {_F}, c AS (SELECT author, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, author) AS rn FROM fr GROUP BY author) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS authors, round(max(n) / sum(n), 6) AS top_share, round(sum(n) FILTER (rn <= 5) / sum(n), 6) AS top5_share FROM c",
    "runlog_outer_join": f"""WITH {RUNS}, e AS (SELECT variant, seed, step + 5 AS step, loss * 2 AS l FROM runs WHERE step % 10 = 0)
SELECT coalesce(r.variant, e.variant) AS variant, coalesce(r.seed, e.seed) AS seed, coalesce(r.step, e.step) AS step, round(r.loss, 6) AS "train/loss", round(e.l, 6) AS "eval/loss" FROM runs r FULL JOIN e ON r.variant = e.variant AND r.seed = e.seed AND r.step = e.step""",
    "runlog_curve": f"WITH {RUNS} SELECT step, round(avg(loss), 6) AS mean, round(min(loss), 6) AS low, round(max(loss), 6) AS high, (SELECT count(DISTINCT (variant, seed)) FROM runs) AS runs FROM runs GROUP BY step",
    "early_stop": f"""WITH RECURSIVE {RUNS}, e AS (SELECT variant, seed, step, loss, row_number() OVER (PARTITION BY variant, seed ORDER BY step) AS k, max(step) OVER (PARTITION BY variant, seed) AS final FROM runs WHERE step % 10 = 0),
m AS (SELECT variant, seed, 1::BIGINT AS k, loss AS best, step AS kept, 0 AS waits, step AS now, final FROM e WHERE k = 1
UNION ALL SELECT e.variant, e.seed, e.k, CASE WHEN e.loss < best - 0.001::DOUBLE THEN e.loss ELSE best END, CASE WHEN e.loss < best - 0.001::DOUBLE THEN e.step ELSE kept END, CASE WHEN e.loss < best - 0.001::DOUBLE THEN 0 ELSE waits + 1 END, e.step, e.final
 FROM m JOIN e ON e.variant = m.variant AND e.seed = m.seed AND e.k = m.k + 1 WHERE waits < 5)
SELECT variant, seed, CAST(arg_max(kept, k) AS INTEGER) AS best_step, CAST(arg_max(now, k) AS INTEGER) AS stop_step, round(arg_max(best, k), 6) AS best_loss FROM m GROUP BY variant, seed""",
    "rolling_loss": f"WITH {RUNS} SELECT variant, seed, step, round(avg(loss) OVER (PARTITION BY variant, seed ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling FROM runs",
}

QUERIES = {
    f.__name__: f for f in (
        dialog_frame, dialog_first_turns, dialog_rating_cells, dialog_escalation, position_zscore, review_verdicts, author_concentration,
        runlog_outer_join, runlog_curve, rolling_loss, early_stop
    )
}
