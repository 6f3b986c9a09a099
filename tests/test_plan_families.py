"""Planned family days are summed from pairs before the days are spread."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfcast.operators import forecast, panel

PAIRS = "store_nbr long, item_nbr long, family string, perishable int, promos map<date,boolean>"


def test_family_days_are_those_of_the_plan_by_day(spark):
    d = lambda k: date(2001, 10, k)
    rows = [
        (1, 1, "A", 0, {d(20): True, d(21): False}), (1, 2, "A", 1, {d(21): None, d(22): True}), (1, 3, "A", 0, None),
        (1, 4, "B", None, {}), (2, 1, "A", 0, {d(30): True}), (None, 5, None, 1, {d(22): True}), (2, 1, "A", 0, {d(20): True}),
    ]
    pairs, origin = spark.createDataFrame(rows, PAIRS), F.lit(d(19))
    got = forecast.plan_families(pairs, origin, 4)
    by_day = panel.fill_promotion(forecast.plan_days(pairs, origin, 4)).withColumn("unit_sales", F.lit(0.0))
    want = panel.to_family(by_day, spark.createDataFrame([], "item_nbr long, family string, perishable int"))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    # each pair is one row until the families are summed
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("bit_or")
