"""Error measures against hand formulas, folds, weights, blending."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import metrics

Y = [2.0, 0.0, 5.0, 10.0, 3.0, 7.0]
P = [2.5, 1.0, 4.0, 8.0, 3.0, 9.0]
FRESH = [1, 0, 1, 0, 1, 0]


def frame(spark, y=Y, p=P, fresh=FRESH):
    return spark.createDataFrame(list(zip(y, p, fresh)), "target double, prediction double, perishable int")


def test_measures_match_formulas(spark):
    m = metrics.evaluate(frame(spark)).first()
    y, p = np.array(Y), np.array(P)
    err = p - y
    assert m["mae"] == pytest.approx(np.abs(err).mean())
    assert m["rmse"] == pytest.approx(np.sqrt((err**2).mean()))
    assert m["rmsle"] == pytest.approx(np.sqrt(((np.log1p(p) - np.log1p(y)) ** 2).mean()))
    assert m["mape"] == pytest.approx((np.abs(err)[y > 0] / y[y > 0]).mean() * 100)
    assert m["wape"] == pytest.approx(np.abs(err).sum() / y.sum() * 100)
    assert m["wmape"] == pytest.approx(m["wape"])
    assert m["r2"] == pytest.approx(1 - (err**2).sum() / ((y - y.mean()) ** 2).sum())
    assert m["zero_rate"] == pytest.approx(1 / 6)


def test_perishable_weights(spark):
    m = metrics.evaluate(frame(spark), perishable="perishable").first()
    y, p, f = np.array(Y), np.array(P), np.array(FRESH)
    w = np.where(f > 0, 1.5, 1.0)
    assert m["wmape"] == pytest.approx((w * np.abs(p - y)).sum() / (w * y).sum() * 100)
    w = np.where(f > 0, 1.25, 1.0)
    log_sq = (np.log1p(p) - np.log1p(y)) ** 2
    assert m["nwrmsle"] == pytest.approx(np.sqrt((w * log_sq).sum() / w.sum()))


def test_perfect_prediction(spark):
    m = metrics.evaluate(frame(spark, p=Y), perishable="perishable").first()
    assert m["rmsle"] == pytest.approx(0) and m["mae"] == pytest.approx(0) and m["r2"] == pytest.approx(1)


def test_negative_predictions_count_as_zero(spark):
    m = metrics.evaluate(frame(spark, p=[-5.0, -1.0, 4.0, 8.0, 3.0, 9.0])).first()
    clipped = metrics.evaluate(frame(spark, p=[0.0, 0.0, 4.0, 8.0, 3.0, 9.0])).first()
    assert m == clipped


def test_constant_target_has_no_r2(spark):
    m = metrics.evaluate(frame(spark, y=[4.0] * 6)).first()
    assert m["r2"] is None


def test_scores_per_fold_and_pooled(spark):
    rows = [(f, y, p, 0.0) for f in (1, 2) for y, p in zip(Y, P)]
    df = spark.createDataFrame(rows, "fold int, target double, a double, b double")
    scores = {(r["model"], r["fold"]): r for r in metrics.score_models(df, ["a", "b"]).collect()}
    assert set(scores) == {(m, f) for m in "ab" for f in (0, 1, 2)}
    assert scores["a", 0]["n"] == 12 and scores["a", 1]["n"] == 6
    assert scores["a", 0]["rmsle"] == pytest.approx(scores["a", 1]["rmsle"])
    mean = {r["model"]: r for r in metrics.average_per_fold(metrics.score_models(df, ["a", "b"])).collect()}
    assert mean["b"]["mae"] == pytest.approx(np.mean(Y))


def test_walk_forward_windows_do_not_overlap(spark):
    first = date(2016, 1, 1)
    days = spark.createDataFrame([(first + timedelta(days=i),) for i in range(500)], "date date")
    got = {
        r["fold"]: (r["lo"], r["hi"], r["n"])
        for r in metrics.walk_forward(days)
        .groupBy("fold")
        .agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n"))
        .collect()
    }
    want = metrics.fold_bounds(first, first + timedelta(days=499))
    assert {f: (lo, hi) for f, _, lo, hi in want} == {f: v[:2] for f, v in got.items()}
    assert all(v[2] == 28 for v in got.values())


def test_short_history_leaves_fewer_folds(spark):
    first = date(2016, 1, 1)
    days = spark.createDataFrame([(first + timedelta(days=i),) for i in range(365 + 30)], "date date")
    assert metrics.walk_forward(days).select("fold").distinct().count() == 1
    assert len(metrics.fold_bounds(first, first + timedelta(days=394))) == 1
    with pytest.raises(ValueError):
        metrics.fold_bounds(first, first + timedelta(days=100))


def test_sample_weight_halves(spark):
    df = spark.createDataFrame([(date(2017, 1, 1), 0), (date(2016, 7, 5), 1)], "date date, perishable int")
    plain = [r[0] for r in df.select(metrics.sample_weight(F.lit(date(2017, 1, 1)))).collect()]
    assert plain == pytest.approx([1.0, 0.5])
    fresh = [r[0] for r in df.select(metrics.sample_weight(F.lit(date(2017, 1, 1)), perishable="perishable")).collect()]
    assert fresh == pytest.approx([1.0, 0.625])


def test_blend_weight_is_the_grid_optimum(spark):
    rng = np.random.default_rng(5)
    y = rng.gamma(2, 5, 400)
    a = np.log1p(y) + rng.normal(0, 0.4, 400)
    b = np.log1p(y) + rng.normal(0.1, 0.6, 400)
    df = spark.createDataFrame(list(zip([1] * 400, y.tolist(), a.tolist(), b.tolist())), "fold int, y double, a double, b double")
    got = metrics.blend_weights(df, "y", "a", "b").first()
    grid = np.linspace(0, 1, 101)
    losses = [np.sqrt(((w * a + (1 - w) * b - np.log1p(y)) ** 2).mean()) for w in grid]
    assert got["weight"] == pytest.approx(grid[int(np.argmin(losses))])
    assert got["rmsle"] == pytest.approx(min(losses))


def test_blend_loss_is_that_of_clipped_sales(spark):
    """Where a blend is negative the loss counts zero sales, and no member alone is better."""
    y = [0.0, 0.0, 0.0, 5.0]
    a, b = [-3.0, -2.0, -4.0, 1.0], [0.5, 0.1, 0.4, 1.5]
    df = spark.createDataFrame(list(zip([1] * 4, y, a, b)), "fold int, y double, a double, b double")
    got = metrics.blend_weights(df, "y", "a", "b").first()
    error = lambda w: np.sqrt(((np.maximum(w * np.array(a) + (1 - w) * np.array(b), 0) - np.log1p(y)) ** 2).mean())
    assert got["rmsle"] == pytest.approx(min(error(w) for w in np.linspace(0, 1, 101)))
    assert got["rmsle"] <= min(error(0), error(1))


def test_blend_weight_stays_inside_bounds(spark):
    y = [1.0, 2.0, 3.0, 4.0]
    good = [float(np.log1p(v)) for v in y]
    bad = [g + 5 for g in good]
    df = spark.createDataFrame(list(zip([1] * 4, y, bad, good)), "fold int, y double, a double, b double")
    assert metrics.blend_weights(df, "y", "a", "b").first()["weight"] == pytest.approx(0.0)


def test_honest_weight_ignores_own_fold(spark):
    rows = [(1, 3.0, np.log1p(3.0), 0.0)] * 5 + [(2, 3.0, 0.0, np.log1p(3.0))] * 5
    df = spark.createDataFrame([(f, y, float(a), float(b)) for f, y, a, b in rows], "fold int, y double, a double, b double")
    sums = metrics.blend_sums(df, ["fold"], "y", "a", "b")
    got = {r["fold"]: r["weight_others"] for r in metrics.leave_one_fold_out(sums).collect()}
    assert got == pytest.approx({1: 0.0, 2: 1.0})


def test_leak_audit_names_the_leaking_feature(spark):
    rows = [(1, date(2017, 1, d), float(d), 5.0) for d in range(1, 11)]
    full = spark.createDataFrame(rows, "k int, date date, leaky double, safe double")
    masked = full.withColumn("leaky", F.when(F.col("date") <= date(2017, 1, 5), F.col("leaky")))
    got = metrics.leak_audit(full, masked, F.lit(date(2017, 1, 5)), ["leaky", "safe"], ["k", "date"]).collect()
    assert [(r["feature"], r["share_changed"]) for r in got] == [("leaky", 1.0)]


def test_parity_report_flags_difference(spark):
    a = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, None)], "k int, same double, holes double")
    b = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0)], "k int, same double, holes double")
    got = {r["feature"]: r for r in metrics.parity_report(a, b, ["same", "holes"], ["k"]).collect()}
    assert not got["same"]["differs"] and got["holes"]["differs"]
    assert got["holes"]["null_rate"] == 0.5 and got["holes"]["null_rate_other"] == 0.0
    assert metrics.missing_features(a.drop("same"), b, ["same", "holes"]) == {"only_first": [], "only_second": ["same"]}
