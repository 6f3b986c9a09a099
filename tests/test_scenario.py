"""Scenario outcomes on constant series, parameter ranges and driver overrides."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import scenario

DAYS = 16


def outcome(spark, base, new, stock, price):
    rows = [(base * DAYS, new * DAYS, stock, price, DAYS)]
    schema = "baseline_total double, scenario_total double, stock double, unit_price double, horizon_days int"
    return scenario.outcome(spark.createDataFrame(rows, schema)).first()


def test_stockout(spark):
    k = outcome(spark, 10.0, 20.0, 100.0, 2.0)
    assert (k["baseline_total"], k["scenario_total"], k["delta_pct"]) == (160.0, 320.0, 100.0)
    assert k["will_stockout"] and k["shortfall"] == 220.0 and k["lost_revenue"] == 440.0
    assert k["verdict"] == "stock-out ahead"


def test_overstock(spark):
    k = outcome(spark, 10.0, 1.0, 1000.0, 1.0)
    assert not k["will_stockout"] and k["overstock"] and k["excess"] == 984.0
    assert k["risk_level"] == "overstock" and k["days_of_cover"] == 999.0


def test_enough_stock(spark):
    k = outcome(spark, 10.0, 12.0, 300.0, 2.0)
    assert not k["will_stockout"] and not k["overstock"] and k["shortfall"] == 0.0
    assert k["verdict"] == "enough stock" and k["risk_level"] == "safe"


def test_zero_baseline_has_no_percentage(spark):
    k = outcome(spark, 0.0, 5.0, 200.0, 1.0)
    assert k["delta_pct"] is None and not k["will_stockout"]


@pytest.mark.parametrize("stock,level", [(50.0, "very high"), (150.0, "high"), (200.0, "medium"), (300.0, "low")])
def test_risk_by_shortfall_ratio(spark, stock, level):
    assert outcome(spark, 10.0, 20.0, stock, 1.0)["risk_level"] == level


def test_numbers_are_finite(spark):
    k = outcome(spark, 0.0, 0.0, 0.0, 1.0).asDict()
    for v in k.values():
        assert v is None or not isinstance(v, float) or abs(v) < float("inf")


def _override(spark, **values):
    base = {"scenario_id": 1, "store_nbr": 1, "family": "A", **values}
    types = {"scenario_id": "long", "store_nbr": "int", "family": "string", **scenario.TYPES}
    schema = ", ".join(f"{k} {types[k]}" for k in base)
    return scenario.with_defaults(spark.createDataFrame([tuple(base.values())], schema))


@pytest.mark.parametrize(
    "values,rejected",
    [
        ({}, []),
        ({"horizon_days": 6}, ["horizon_days"]),
        ({"demand_multiplier": -0.1}, ["demand_multiplier"]),
        ({"demand_multiplier": float("nan")}, ["demand_multiplier"]),
        ({"demand_multiplier": float("inf")}, ["demand_multiplier"]),
        ({"promo_days": 17, "oil_price": 19.0}, ["promo_days", "oil_price"]),
        ({"traffic_change_pct": -91.0}, ["traffic_change_pct"]),
        ({"event_type": "flood"}, ["event_type"]),
        ({"stock_override": -1.0, "lead_time_override": 61.0}, ["stock_override", "lead_time_override"]),
        ({"oil_price": 200.0, "traffic_change_pct": 200.0, "horizon_days": 7}, []),
    ],
)
def test_parameter_ranges(spark, values, rejected):
    df = _override(spark, **values)
    assert scenario.check_overrides(df).first()["rejected"] == rejected
    assert scenario.valid_overrides(df).isEmpty() == bool(rejected)
    assert scenario.rejected_overrides(df).isEmpty() == (not rejected)


def test_fallback_multiplies_once(spark):
    """A series without a model is the baseline times the factor, not its square."""
    over = _override(spark, demand_multiplier=2.0)
    base = spark.createDataFrame([(1, 1, "A", 10.0)] * 3, "scenario_id long, store_nbr int, family string, baseline_sales double")
    none = spark.createDataFrame([], "scenario_id long, store_nbr int, family string, prediction double, planned double")
    stock = spark.createDataFrame([], "store_nbr int, family string, stock double, lead_time double, sku_count long")
    price = spark.createDataFrame([], "family string, unit_price double")
    got = scenario.scenario_totals(over, base, none, stock, price).first()
    assert got["scenario_total"] == 60.0 and got["source"] == "scaled baseline"
    assert got["unit_price"] == 5.0 and got["lead_time"] == 3.0


def test_overrides_cover_the_first_days(spark, tables):
    days = scenario.window_days(tables.forecasts)
    one = tables.panel.select("store_nbr", "family").limit(1).first()
    over = _override(
        spark, store_nbr=one["store_nbr"], family=one["family"], promo_days=3, oil_price=77.0, event_type="earthquake",
        event_days=2, traffic_change_pct=50.0, horizon_days=10,
    )
    traffic = spark.createDataFrame([(one["store_nbr"], 40.0)], "store_nbr int, last_traffic double")
    got = scenario.future_drivers(
        over, days, tables.stores, tables.oil, tables.holidays, tables.planned_promotions, traffic
    ).orderBy("day_index").collect()
    assert [r["onpromotion"] for r in got] == [1] * 3 + [0] * 7
    assert [r["is_earthquake_period"] for r in got][:3] == [True, True, False]
    assert {r["oil_price"] for r in got} == {77.0} and {r["transactions_lag1"] for r in got} == {60.0}


def test_neutral_scenario_is_the_baseline_and_each_override_moves_it(spark, tables):
    from shelfcast.plans.queries.scenarios import scenario_sensitivity

    got = {r["kind"]: r for r in scenario_sensitivity(tables).collect()}
    assert set(got) == {"neutral", "oil", "traffic", "holiday", "earthquake", "promotion"}
    assert abs(got["neutral"]["delta"]) < 1e-9 and got["neutral"]["baseline_total"] > 0
    assert all(abs(r["delta"]) > 1e-6 for k, r in got.items() if k != "neutral"), got
