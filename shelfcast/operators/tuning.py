"""Walk-forward training of the global models: all folds, seeds and trials in one job each.

A run is a fold with a seed, or a trial of settings; runs are groups of the grouped boosting, so they grow
together, a pass over the rows a level.  The number of rounds comes from inside a run's training days:
trees are grown without the last `INNER_DAYS` of them, the loss curve on these days picks the rounds, and
the run is fitted again on all its training days with `GROW` times as many.  A fold's validation days are read by
nothing but its scores.
"""

from __future__ import annotations

import math
import random
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.durable import cut
from shelfcast.operators.boosting import Plan, cut_points, fit_boosted, staged_losses, with_tree_score
from shelfcast.operators.forecast import MODEL, _solver, product_sums
from shelfcast.operators.metrics import sample_weight

INNER_DAYS, GROW, SAMPLE = 14, 1.1, 0.8
FOLDS, VALIDATION_DAYS = 3, 28
LINEAR_RIDGE = 10.0


# ---------------------------------------------------------------- folds


def fold_end(last_day: Column, fold: Column, folds: int = FOLDS, days: int = VALIDATION_DAYS) -> Column:
    """Last training day of a fold; the newest fold is number `folds`, and validates the last `days` days."""
    return F.date_sub(last_day, (F.lit(folds + 1) - fold) * days)


def training_rows(rows: DataFrame, folds: int = FOLDS, days: int = VALIDATION_DAYS) -> DataFrame:
    """Each of `rows` once for every fold that trains on it, with `fold`, `train_end` and a recency `weight`."""
    last = rows.agg(F.max("date")).scalar()
    each = rows.withColumn("_last", last).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    each = each.withColumn("train_end", fold_end(F.col("_last"), F.col("fold"), folds, days)).drop("_last")
    return each.filter(F.col("date") <= F.col("train_end")).withColumn("weight", sample_weight(F.col("train_end")))


def validation_rows(rows: DataFrame, folds: int = FOLDS, days: int = VALIDATION_DAYS) -> DataFrame:
    """The rows of each fold's validation days, with `fold`."""
    last = rows.agg(F.max("date")).scalar()
    back = F.floor(F.datediff(last, "date") / days).cast("int")
    return rows.withColumn("fold", F.lit(folds) - back).filter(F.col("fold") >= 1)


# ---------------------------------------------------------------- two phases


def seeded(rows: DataFrame, seeds: tuple[int, ...], keys: list[str], share: float = SAMPLE) -> DataFrame:
    """Rows of each (fold, seed) as `run`, with `drawn`: whether the seed draws the row for training."""
    each = rows.withColumn("_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    ticket = F.pmod(F.xxhash64("_seed", *keys), F.lit(1000)) < int(1000 * share)
    return each.withColumns({"run": F.concat_ws("/", F.col("fold").cast("string"), F.col("_seed").cast("string")), "drawn": ticket}).drop("_seed")


def fit_two_phase(train: DataFrame, features: list[str], label: str, keys: list[str], seeds: tuple[int, ...] = (7, 11), plan: Plan | None = None, most_rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """Models (run, base, trees) of `training_rows`, and per run `rounds` with the smallest inner loss, `loss`,
    `first_loss` (no trees) and `fitted_rounds`."""
    plan = replace(plan or Plan(), pooled_rounds=0, group_rounds=most_rounds)
    rows = cut(seeded(train, seeds, keys).select("run", "date", "train_end", "drawn", "weight", label, *features))
    inner = F.col("date") > F.date_sub("train_end", INNER_DAYS)
    cuts = cut_points(rows.filter("drawn"), features, plan.bins)
    trial = cut(fit_boosted(rows.filter(~inner & F.col("drawn")), "run", features, label, plan, "weight", cuts).filter("run IS NOT NULL"))
    curve = cut(staged_losses(rows.filter(inner), trial, "run", features, label, "weight", plan.depth))
    chosen = curve.groupBy("run").agg(F.min(F.struct("loss", "rounds")).alias("_b"), F.max(F.when(F.col("rounds") == 0, F.col("loss"))).alias("first_loss"))
    fitted = F.ceil(F.lit(GROW) * F.greatest(F.col("_b.rounds"), F.lit(1))).cast("int")
    chosen = cut(chosen.select("run", F.col("_b.rounds").alias("rounds"), F.col("_b.loss").alias("loss"), "first_loss", fitted.alias("fitted_rounds")))
    longest = chosen.agg(F.coalesce(F.max("fitted_rounds"), F.lit(0))).first()[0]
    whole = fit_boosted(rows.filter("drawn"), "run", features, label, replace(plan, group_rounds=longest), "weight", cuts)
    # trees come in order, so a run's first trees are those it would have with its own number of rounds
    models = whole.join(chosen, "run").select("run", "base", F.slice("trees", F.lit(1), F.col("fitted_rounds")).alias("trees"))
    return cut(models), chosen


def score_runs(rows: DataFrame, models: DataFrame, features: list[str], seeds: tuple[int, ...], out: str, depth: int = Plan.depth) -> DataFrame:
    """`rows` (with `fold`) and `out`, the mean score of the fold's seeds."""
    for k, seed in enumerate(seeds):
        one = rows.withColumn("run", F.concat_ws("/", F.col("fold").cast("string"), F.lit(str(seed))))
        rows = with_tree_score(one, models, "run", features, f"_s{k}", depth).drop("run")
    mean = sum((F.col(f"_s{k}") for k in range(len(seeds))), F.lit(0.0)) / len(seeds)
    return rows.withColumn(out, mean).drop(*[f"_s{k}" for k in range(len(seeds))])


def fit_linear_folds(train: DataFrame, features: list[str], label: str) -> DataFrame:
    """fold and coef of a weighted ridge fit per fold, from one aggregation; missing features count as zero."""
    names = ["one", *features]
    filled = train.select("fold", F.col("weight"), F.col(label).alias("y"), F.lit(1.0).alias("one"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    sums = product_sums(filled, ["fold"], F.col("weight"), names)
    ready = sums.select(F.col("fold").cast("string").alias("family"), "n_rows", F.lit(LINEAR_RIDGE).alias("ridge"), "gram", "cross", F.lit(None).cast("array<double>").alias("prior"))
    return ready.mapInPandas(_solver(len(names)), MODEL).select(F.col("family").cast("int").alias("fold"), "coef")


def score_linear(rows: DataFrame, models: DataFrame, features: list[str], out: str) -> DataFrame:
    terms = [F.col("coef")[0], *[F.col("coef")[k] * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for k, f in enumerate(features, 1)]]
    return rows.join(models, "fold").withColumn(out, sum(terms[1:], terms[0])).drop("coef")


# ---------------------------------------------------------------- search


def neighbours(plan: Plan, draw: random.Random, n: int) -> list[Plan]:
    """Plans drawn around one."""
    step = lambda x, f: x * f ** draw.uniform(-1, 1)
    return [replace(plan, rate=min(1.0, step(plan.rate, 2.0)), shrink=step(plan.shrink, 4.0), least_rows=step(plan.least_rows, 3.0)) for _ in range(n)]


def search_halving(train: DataFrame, held: DataFrame, features: list[str], label: str, default: Plan | None = None, trials: int = 6, rungs: int = 3, first_rounds: int = 2, seed: int = 1, gain: float = 0.01) -> tuple[Plan, list[dict]]:
    """The best plan found, or `default` unless it is at least `gain` better; and a row per rung and trial.

    All trials of a rung grow in one job, as groups.  A rung has twice the rounds of the one before; its better half
    goes on, and half as many are drawn around the best one so far, so later trials follow earlier results.
    The default goes along to the end.
    """
    default, draw = default or Plan(), random.Random(seed)
    alive: dict[str, Plan] = {"default": default} | {f"t{k}": p for k, p in enumerate(neighbours(default, draw, trials))}
    report: list[dict] = []
    cuts = cut_points(train, features, default.bins)
    rounds, made = first_rounds, trials
    for rung in range(rungs):
        names = F.explode(F.array(*[F.lit(n) for n in alive]))
        plan = replace(default, pooled_rounds=0, group_rounds=rounds)
        models = fit_boosted(train.withColumn("trial", names), "trial", features, label, plan, cuts=cuts, settings=alive).filter("trial IS NOT NULL")
        losses = staged_losses(held.withColumn("trial", names), cut(models), "trial", features, label, depth=default.depth)
        found = {r["trial"]: math.sqrt(r["loss"]) for r in losses.filter(F.col("rounds") == rounds).collect()}  # a row a trial
        order = sorted(alive, key=lambda n: (found.get(n, math.inf), n))
        kept = order[: max(1, len(order) // 2)]
        report += [
            {"rung": rung, "trial": n, "rounds": rounds, "rate": alive[n].rate, "shrink": alive[n].shrink, "least_rows": alive[n].least_rows, "error": found.get(n), "kept": n in kept}
            for n in order
        ]
        if rung + 1 == rungs:
            break
        best = alive[kept[0]]
        new = neighbours(best, draw, max(1, len(kept) // 2))
        alive = {n: alive[n] for n in dict.fromkeys(["default", *kept])} | {f"t{made + k}": p for k, p in enumerate(new)}
        made, rounds = made + len(new), 2 * rounds
    last = {r["trial"]: r["error"] for r in report if r["rung"] == rungs - 1 and r["error"] is not None}
    if not last:
        return default, report
    best = min(last, key=lambda n: (last[n], n))
    better = last["default"] > 0 and (last["default"] - last[best]) / last["default"] >= gain
    return (alive[best] if better else default), report
