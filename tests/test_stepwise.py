"""The day-by-day forecast: same features as in training, routes inside the loop, no row lost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import stepwise
from shelfcast.operators.features import extended_features, extended_names


def test_state_features_are_those_of_training(tables):
    last = tables.panel.agg(F.max("date")).first()[0]
    panel = tables.panel.drop("transactions_lag1").filter("store_nbr < 4")
    known, ahead = panel.filter(F.col("date") < last), panel.filter(F.col("date") == last)
    state = stepwise.initial_state(known)
    got = stepwise.state_features(state.join(ahead.select("store_nbr", "family", "date", "onpromotion"), ["store_nbr", "family"]))
    want = extended_features(panel, 1).filter(F.col("date") == last)
    names = extended_names(1, traffic=False)
    both = got.select("store_nbr", "family", *[F.col(n).alias(f"a_{n}") for n in names]).join(want.select("store_nbr", "family", *names), ["store_nbr", "family"])
    assert both.count() == ahead.count() > 5
    for n in names:
        a, b = F.col(f"a_{n}").cast("double"), F.col(n).cast("double")
        assert both.filter(~(a.eqNullSafe(b) | (F.abs(a - b) < 1e-9))).isEmpty(), n


def test_every_series_and_day_comes_back_with_its_route(spark, tables):
    days = tables.future.select("date").distinct().orderBy("date").limit(3)
    future = tables.future.filter("store_nbr < 3").join(days, "date").select("store_nbr", "family", "date", "onpromotion")
    new = spark.createDataFrame([(99, "NEW", True), (99, "PROMO", False)], "store_nbr int, family string, onpromotion boolean").join(days)
    future = future.unionByName(new.select(*future.columns))
    families = [r[0] for r in future.select("family").distinct().orderBy("family").collect()]
    routes = spark.createDataFrame([(f, ["local", "global", "unheard"][k % 3]) for k, f in enumerate(f for f in families if f != "NEW")], "family string, route string")
    models = {
        "local": lambda rows, out: rows.withColumn(out, F.coalesce("slog_lag1", F.lit(0.0)) + 1.0),
        "global": lambda rows, out: rows.withColumn(out, F.when(F.col("slog_lag7") > 0, F.lit(-3.0)).otherwise(F.col("days_since_sale") / 100.0)),
    }
    got = stepwise.forecast_stepwise(tables.panel, future, models, routes)
    assert got.count() == future.count() == got.select("store_nbr", "family", "date").distinct().count()
    assert got.filter("prediction IS NULL OR prediction < 0 OR horizon_day NOT BETWEEN 1 AND 3").isEmpty()
    used = {r[0]: r[1] for r in got.select("family", "used_model").distinct().collect()}
    given = {r[0]: r[1] for r in routes.collect()}
    assert used == {f: given.get(f) if given.get(f) in models else "zero" for f in families}
    assert got.filter("used_model = 'zero' AND prediction <> 0").isEmpty()
    # each day of the local model adds one to the log of the day before
    local = got.filter("used_model = 'local'").withColumn("y", F.log1p("prediction")).groupBy("store_nbr", "family").pivot("horizon_day", [1, 2, 3]).agg(F.first("y")).collect()
    assert local and all(r["2"] == pytest.approx(r["1"] + 1) and r["3"] == pytest.approx(r["1"] + 2) for r in local)


def test_no_future(tables):
    none = stepwise.forecast_stepwise(tables.panel, tables.future.limit(0), {}, tables.items.select("family").distinct().withColumn("route", F.lit("x")))
    assert none.count() == 0 and none.columns == ["store_nbr", "family", "date", "horizon_day", "prediction", "used_model"]
