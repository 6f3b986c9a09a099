"""Recursion, ridge fits and splits against direct computation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import ensemble, features, forecast
from shelfcast.operators.forecast import LOCAL_FEATURES
from shelfcast.plans.queries.forecasting import CHECK_COEFFICIENTS, POOLED, check_models


def test_recursion_matches_a_plain_loop(tables):
    panel, future = tables.panel.toPandas(), tables.future.toPandas()
    got = forecast.forecast_recursive(tables.panel, tables.future, check_models(tables)).toPandas()
    coef = np.array([CHECK_COEFFICIENTS[c] for c in LOCAL_FEATURES])
    checked = 0
    for (store, family), plan in future.groupby(["store_nbr", "family"]):
        mine = got[(got.store_nbr == store) & (got.family == family)].sort_values("date")
        assert set(mine.used_model) == {"pooled" if family == "LARGE" else "local"}
        s = panel[(panel.store_nbr == store) & (panel.family == family)].sort_values("date")
        logs = list(np.log1p(s.target.clip(lower=0)))[-28:]
        logs = [0.0] * (28 - len(logs)) + logs
        want = []
        for r in plan.sort_values("date").itertuples():
            x = [1, logs[-1], logs[-7], logs[-14], np.mean(logs[-7:]), np.mean(logs[-28:]),
                 np.mean([logs[-7], logs[-14], logs[-21], logs[-28]]), float(r.onpromotion),
                 float(r.date.weekday() >= 5), 0.0]
            end = (r.date.replace(day=28) + np.timedelta64(4, "D").astype(object)).replace(day=1)
            x[-1] = float(r.date.day == 15 or (end - r.date).days == 1)
            logs.append(max(0.0, float(coef @ np.array(x)) * (POOLED if family == "LARGE" else 1.0)))
            want.append(np.expm1(logs[-1]))
        assert np.allclose(mine.prediction, want)
        checked += 1
    assert checked > 10


def test_training_and_recursion_see_the_same_features(tables):
    """One step ahead, the array form and the window form give the same prediction."""
    last = tables.panel.agg(F.max("date")).first()[0]
    known = tables.panel.filter(F.col("date") < last)
    ahead = tables.panel.filter(F.col("date") == last).select("store_nbr", "family", "date", "onpromotion")
    stepped = forecast.forecast_recursive(known, ahead, check_models(tables))
    rows = forecast.complete_rows(forecast.local_features(tables.panel)).filter(F.col("date") == last)
    windowed = forecast.with_coefficients(rows, check_models(tables)).withColumn("w", F.expm1(forecast.linear_score()))
    both = stepped.join(windowed.select("store_nbr", "family", "w"), ["store_nbr", "family"])
    assert both.count() == windowed.count() > 0
    assert both.filter(F.abs(F.col("prediction") - F.col("w")) > 1e-9).isEmpty()


def test_ridge_solves_the_normal_equations(tables):
    rows = forecast.complete_rows(forecast.local_features(tables.panel))
    models = {r["family"]: r for r in tables.local_models.collect()}
    pdf = rows.select("family", "y", *LOCAL_FEATURES).toPandas()
    pooled = models.pop(None)
    for family, m in [(None, pooled), *models.items()]:
        part = pdf if family is None else pdf[pdf.family == family]
        x, y = part[LOCAL_FEATURES].to_numpy(float), part.y.to_numpy(float)
        ridge = np.full(len(LOCAL_FEATURES), m["ridge"])
        ridge[0] = 1e-9 if family is None else ridge[0]
        prior = np.zeros(len(ridge)) if family is None else np.array(pooled["coef"])
        want = np.linalg.solve(x.T @ x + np.diag(ridge), x.T @ y + ridge * prior)
        assert np.allclose(m["coef"], want, atol=1e-8)
        assert m["n_rows"] == len(part)


def test_families_of_any_size_are_drawn_to_the_pooled_model(spark):
    p = len(LOCAL_FEATURES)
    eye = lambda n: [float(n) if i == j else 0.0 for i in range(p) for j in range(i, p)]
    rows = [("tiny", 1, eye(1), [3.0] * p), ("large", 100_000, eye(100_000), [1e5] * p)]
    df = spark.createDataFrame(rows, "family string, n_rows long, gram array<double>, cross array<double>")
    got = {r["family"]: r for r in forecast.solve_families(df).collect()}
    assert set(got) == {"tiny", "large", None}
    pooled = got[None]["coef"][1]
    assert pooled == pytest.approx(100_003 / 100_011)
    assert got["tiny"]["coef"][1] == pytest.approx((3 + 10 * pooled) / 11) and got["large"]["coef"][1] == pytest.approx(1.0, abs=1e-3)


def test_no_series_is_lost(spark, tables):
    """No history, no model of its own, no model at all: each has its days and says what made them."""
    new = spark.createDataFrame([(999, "LARGE"), (999, "NEW")], "store_nbr int, family string")
    days = tables.future.select("date").distinct().withColumn("onpromotion", F.lit(False))
    future = tables.future.select("store_nbr", "family", "date", "onpromotion").unionByName(new.join(days))
    got = forecast.forecast_recursive(tables.panel, future, check_models(tables))
    assert got.count() == future.count() and got.filter("prediction IS NULL OR prediction < 0").isEmpty()
    assert {r[0] for r in got.filter("store_nbr = 999").select("used_model").distinct().collect()} == {"pooled"}
    none = forecast.forecast_recursive(tables.panel, future, check_models(tables).filter("family IS NOT NULL"))
    assert none.filter("used_model = 'zero' AND prediction <> 0").isEmpty() and none.count() == future.count()


def test_search_keeps_default_without_a_clear_gain(tables):
    got = forecast.search_ridge(tables.panel, [1.0, 1e6]).collect()
    assert got
    for r in got:
        assert r["accepted"] == (r["improvement"] >= 0.01)
        assert r["best_rmsle"] <= r["default_rmsle"] + 1e-12 or not r["accepted"]


def test_split_keeps_family_totals(tables):
    """Where every planned item has a share, items add up to the family forecast."""
    shares = tables.shares.groupBy("store_nbr", "family").agg(F.sum("share").alias("s"))
    assert shares.filter("s > 0").filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()
    back = tables.family_forecast.join(tables.family_prediction, ["store_nbr", "family", "date"])
    assert back.filter(F.col("predicted_sales") > F.col("prediction") + 1e-5).isEmpty()


def test_plan_ids_are_unique(tables):
    assert tables.plan.count() == tables.plan.select("id").distinct().count()


def test_routes(spark):
    fam = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "family string")
    local = spark.createDataFrame([("a", 1.3), ("b", 1.31), ("d", 9.0)], "family string, rmsle double")
    ref = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "family string, rmsle double")
    got = {r["family"]: r["route"] for r in forecast.choose_routes(fam, local, ref).collect()}
    assert got == {"a": "local", "b": "global", "c": "none", "d": "local"}
    df = fam.withColumns({"l": F.lit(-1.0), "g": F.lit(2.0)})
    out = {r["family"]: (r["prediction"], r["used_model"]) for r in forecast.routed_prediction(df, forecast.choose_routes(fam, local, ref), "l", "g").collect()}
    assert out == {"a": (0.0, "local"), "b": (2.0, "global"), "c": (0.0, "none"), "d": (0.0, "local")}


def test_ensemble_survives_save_and_load(spark, tables, tmp_path):
    featured = features.extended_features(tables.panel.drop("transactions_lag1"), 16).withColumn("dayofweek", F.weekday("date"))
    rows = ensemble.model_rows(featured, 16).filter(F.col("date") > F.date_sub(tables.origin, 200)).cache()
    trained = rows.withColumn("weight", F.lit(1.0))
    fitted = ensemble.Ensemble([ensemble.fit_trees(trained, 1, 2, 2)], ensemble.fit_linear(trained), 0.4)
    ensemble.save_ensemble(fitted, str(tmp_path), spark)
    loaded = ensemble.load_ensemble(str(tmp_path), spark)
    future = tables.future.drop("transactions_lag1")
    history = tables.panel.drop("transactions_lag1").filter(F.col("date") > F.date_sub(tables.origin, 90))
    a = ensemble.forecast_direct(history, future, fitted, 16)
    b = ensemble.forecast_direct(history, future, loaded, 16).withColumnRenamed("prediction", "again")
    both = a.join(b, ["store_nbr", "family", "date"])
    assert both.count() == tables.future.count()
    assert both.filter("prediction IS NULL OR prediction < 0 OR abs(prediction - again) > 1e-9").isEmpty()
    rows.unpersist()


def test_tweedie_member_fits(spark, tables):
    featured = features.extended_features(tables.panel.drop("transactions_lag1"), 16).withColumn("dayofweek", F.weekday("date"))
    rows = ensemble.model_rows(featured, 16).filter(F.col("date") > F.date_sub(tables.origin, 60))
    model = ensemble.fit_linear(rows.withColumn("weight", F.lit(1.0)), tweedie=True)
    assert ensemble.score(rows, [model], "p").filter("p IS NULL").isEmpty()


@pytest.fixture(scope="module")
def recent_rows(tables):
    featured = features.extended_features(tables.panel.drop("transactions_lag1"), 16).withColumn("dayofweek", F.weekday("date"))
    return ensemble.model_rows(featured, 16).filter(F.col("date") > F.date_sub(tables.origin, 120))


def test_early_stopping_uses_marked_rows(tables, recent_rows):
    marked = recent_rows.withColumn("weight", F.lit(1.0)).withColumn("held", F.col("date") > F.date_sub(tables.origin, 28))
    model = ensemble.fit_trees(marked, 1, iterations=5, depth=2, early_stop="held")
    assert 1 <= model.stages[-1].getNumTrees <= 5


def test_tree_search_has_an_acceptance_gate(tables, recent_rows):
    default, other = {"iterations": 2, "depth": 2}, {"iterations": 3, "depth": 3}
    split = (F.date_sub(tables.origin, 28), tables.origin)
    chosen, report = ensemble.search_trees(recent_rows, *split, [other], default, gain=0.9)
    assert chosen == default and report.count() == 2
    chosen, _ = ensemble.search_trees(recent_rows, *split, [], default)
    assert chosen == default


def test_retrain_publishes_nothing_when_the_forecast_is_empty(spark, tables, tmp_path):
    from shelfcast.plans.retrain import retrain
    from shelfcast.plans.serving import RetailTables
    from shelfcast.sources.snapshots import Snapshots

    t = RetailTables(spark, "/root/testdata/sf0.001", root=tables.root)
    t.__dict__["plan"] = tables.plan.limit(0)
    log = Snapshots(spark, str(tmp_path / "out"))
    with pytest.raises(RuntimeError, match="empty"):
        retrain(t, log)
    assert log.versions() == []


def test_retrain_publishes_three_tables_or_none(spark, tables, tmp_path, monkeypatch):
    from shelfcast.plans import retrain
    from shelfcast.sources.snapshots import Snapshots

    log = Snapshots(spark, str(tmp_path))
    with monkeypatch.context() as patch:
        patch.setattr(retrain, "sku_stats", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            retrain.retrain(tables, log)
    assert log.versions() == []
    done = retrain.retrain(tables, log)
    assert sorted(done.tables) == ["forecasts", "inventory", "sku_stats"] and log.versions() == [1]
    forecasts = done.read("forecasts")
    assert forecasts.count() == tables.plan.count() and forecasts.filter("predicted_sales < 0").isEmpty()
    assert done.read("inventory").count() == tables.plan.select("store_nbr", "item_nbr").distinct().count()
    assert done.read("sku_stats").count() == tables.items.count()
