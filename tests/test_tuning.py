"""Two-phase training and the search: rounds from inside the training days, validation days unread."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import tuning
from shelfcast.operators.boosting import Plan, with_tree_score

FEATURES = ["a", "b"]
LAST = date(2020, 6, 30)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for k in range(120):
        for s in range(6):
            a, b = rng.random(), rng.gauss(0, 1)
            data.append((s, LAST - timedelta(days=k), a, b, 3.0 * (a > 0.5) + 0.3 * b + rng.gauss(0, 0.4)))
    return spark.createDataFrame(data, "store_nbr int, date date, a double, b double, y double").repartition(3)


def test_folds_partition_the_last_days(rows):
    train, held = tuning.training_rows(rows, 2, 20), tuning.validation_rows(rows, 2, 20)
    spans = {r["fold"]: (r["lo"], r["hi"]) for r in held.groupBy("fold").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()}
    assert spans == {2: (LAST - timedelta(days=19), LAST), 1: (LAST - timedelta(days=39), LAST - timedelta(days=20))}
    ends = {r["fold"]: r["hi"] for r in train.groupBy("fold").agg(F.max("date").alias("hi")).collect()}
    assert ends == {f: lo - timedelta(days=1) for f, (lo, _) in spans.items()}
    assert train.filter("weight > 1 OR weight <= 0 OR (date = train_end) <> (weight = 1)").isEmpty()


def test_rounds_come_from_the_inner_days_and_validation_days_are_unread(rows):
    plan = Plan(depth=2, bins=8, rate=0.5, shrink=2.0, least_rows=5.0)
    fit = lambda r: tuning.fit_two_phase(tuning.training_rows(r, 2, 20), FEATURES, "y", ["store_nbr", "date"], (1, 2), plan, 5)
    models, chosen = fit(rows)
    found = {r["run"]: r for r in chosen.collect()}
    assert set(found) == {"1/1", "1/2", "2/1", "2/2"}
    assert all(0 < r["rounds"] <= 5 and r["loss"] < r["first_loss"] and r["fitted_rounds"] == int(np.ceil(1.1 * r["rounds"])) for r in found.values())
    assert all(len(r["trees"]) == found[r["run"]]["fitted_rounds"] for r in models.collect())
    # other values on the validation days of the newest fold leave its models as they are
    changed = rows.withColumn("y", F.when(F.col("date") > F.lit(LAST - timedelta(days=20)), F.lit(99.0)).otherwise(F.col("y")))
    same = {r["run"]: r for r in fit(changed)[0].collect()}
    for r in models.collect():
        assert r["base"] == pytest.approx(same[r["run"]]["base"])
        assert [t["cut"] for t in r["trees"]] == [t["cut"] for t in same[r["run"]]["trees"]]
    held = tuning.score_runs(tuning.validation_rows(rows, 2, 20), models, FEATURES, (1, 2), "p", 2)
    got = held.groupBy("fold").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("e"), F.variance("y").alias("v")).collect()
    assert len(got) == 2 and all(r["e"] < 0.3 * r["v"] for r in got)
    one = with_tree_score(held.withColumn("run", F.concat(F.col("fold").cast("string"), F.lit("/1"))), models, "run", FEATURES, "q1", 2)
    two = with_tree_score(one.withColumn("run", F.concat(F.col("fold").cast("string"), F.lit("/2"))), models, "run", FEATURES, "q2", 2)
    assert two.filter(F.abs((F.col("q1") + F.col("q2")) / 2 - F.col("p")) > 1e-9).isEmpty()


def test_linear_folds_solve_weighted_normal_equations(rows):
    train = tuning.training_rows(rows, 2, 20)
    got = {r["fold"]: r["coef"] for r in tuning.fit_linear_folds(train, FEATURES, "y").collect()}
    for fold, part in train.toPandas().groupby("fold"):
        x = np.column_stack([np.ones(len(part)), part[FEATURES].to_numpy(float)])
        w = part.weight.to_numpy(float)[:, None]
        want = np.linalg.solve(x.T @ (w * x) + np.diag([1e-9, 10.0, 10.0]), x.T @ (w[:, 0] * part.y.to_numpy(float)))
        assert got[fold] == pytest.approx(want)


def test_search_halves_follows_the_better_and_has_a_gate(rows):
    train, held = rows.filter(F.col("date") <= F.lit(LAST - timedelta(days=28))), rows.filter(F.col("date") > F.lit(LAST - timedelta(days=28)))
    slow = Plan(depth=2, bins=8, rate=0.05, shrink=2.0, least_rows=5.0)
    best, report = tuning.search_halving(train, held, FEATURES, "y", slow, trials=4, rungs=2, seed=3)
    assert best.rate > slow.rate and [r["rounds"] for r in report if r["trial"] == "default"] == [2, 4]
    first = [r for r in report if r["rung"] == 0]
    assert sum(r["kept"] for r in first) == len(first) // 2 and max(r["error"] for r in first if r["kept"]) <= min(r["error"] for r in first if not r["kept"])
    again, same = tuning.search_halving(train, held, FEATURES, "y", slow, trials=4, rungs=2, seed=3)
    assert again == best and [r["trial"] for r in same] == [r["trial"] for r in report]
    kept, _ = tuning.search_halving(train, held, FEATURES, "y", slow, trials=2, rungs=1, gain=0.99)
    assert kept == slow
