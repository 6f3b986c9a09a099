"""The plan and the item forecast kept by pair: same rows as joins of every day, without moving the days."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfcast.operators import aggregates, forecast

LAST = datetime.date(2020, 1, 31)
DAY = datetime.date(2020, 2, 1)
AFTER = datetime.date(2020, 2, 2)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def small(spark):
    sold = spark.createDataFrame([(1, 10, 5.0), (1, 11, 1.0), (2, 10, 2.0), (2, 12, 2.0), (2, 12, 3.0)], "store_nbr int, item_nbr long, unit_sales double")
    promos = spark.createDataFrame(
        [(DAY, 1, 10, 0), (DAY, 1, 10, 1), (AFTER, 1, 10, None), (None, 1, 11, 1), (DAY, 3, 10, 1), (AFTER, 2, 12, 0)],
        "date date, store_nbr int, item_nbr long, onpromotion int",
    )
    # item 12 is not in the catalogue, item 11 twice
    items = spark.createDataFrame([(10, "a", 1), (11, "a", 0), (11, "b", 1)], "item_nbr long, family string, perishable int")
    shares = spark.createDataFrame([(1, 10, "a", 0.25), (1, 11, "a", 0.75), (2, 12, None, 0.5)], "store_nbr int, item_nbr long, family string, share double")
    ahead = spark.createDataFrame([(1, "a", DAY, 8.0), (1, "b", DAY, 4.0), (1, "a", AFTER, -2.0), (2, "a", DAY, 1.0)], "store_nbr int, family string, date date, prediction double")
    return sold, promos, items, shares, ahead


def test_plan_days_are_the_rows_of_a_join_by_day(small):
    sold, promos, *_ = small
    pairs = forecast.number_pairs(forecast.planned_pairs(sold, promos))
    assert pairs.count() == 4
    got = forecast.plan_days(pairs, F.lit(LAST), 3)
    days = sold.select("store_nbr", "item_nbr").distinct().withColumn("date", F.explode(forecast.future_days(F.lit(LAST), 3)))
    flags = promos.groupBy("date", "store_nbr", "item_nbr").agg(F.bool_or(F.col("onpromotion").cast("boolean")).alias("onpromotion"))
    want = forecast.number_rows(days.join(flags, ["date", "store_nbr", "item_nbr"], "left"), F.lit(LAST))
    columns = ["store_nbr", "item_nbr", "date", "onpromotion", "id"]
    assert rows_of(got.select(columns)) == rows_of(want.select(columns))
    assert rows_of(forecast.assortment_plan(sold, promos, F.lit(LAST), 3)) == rows_of(want.drop("id"))


def test_split_of_rows_that_carry_family_and_share_is_the_split_by_joins(small):
    sold, promos, items, shares, ahead = small
    pairs = forecast.number_pairs(forecast.planned_pairs(sold, promos))
    plain = forecast.plan_days(pairs, F.lit(LAST), 2)
    joined = forecast.with_shares(pairs.join(items.select("item_nbr", "family"), "item_nbr", "left"), shares)
    carried = forecast.plan_days(joined, F.lit(LAST), 2)
    got, want = (rows_of(forecast.split_to_items(rows, items, ahead, shares)) for rows in (carried, plain))
    assert got == want and len(got) == 10
    planned = aggregates.future_promotions(forecast.plan_days(pairs.join(items.select("item_nbr", "family"), "item_nbr", "left"), F.lit(LAST), 2), items)
    assert rows_of(planned) == rows_of(aggregates.future_promotions(plain, items))


def test_keys_beyond_the_bits_raise_before_days_are_made(spark):
    for store, item in ((2**20, 1), (None, 1), (1, None)):
        with pytest.raises(PySparkException):
            forecast.number_pairs(spark.createDataFrame([(store, item)], "store_nbr int, item_nbr long")).collect()
    with pytest.raises(ValueError):
        forecast.plan_days(forecast.number_pairs(spark.createDataFrame([(1, 1)], "store_nbr int, item_nbr long")), F.lit(LAST), 64)


def test_item_forecast_moves_no_days(spark, tables):
    """Reading the plan or the item forecast shuffles nothing, and their families meet pairs."""

    assert tables.planned_pairs.count() * tables.horizon == tables.plan.count()
    for rows in (tables.plan, tables.forecasts):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    by_family = tables.forecasts.join(tables.items.select("item_nbr", "family"), "item_nbr").groupBy("store_nbr", "date", "family").agg(F.sum("predicted_sales").alias("s"))
    both = tables.family_forecast.join(by_family, ["store_nbr", "date", "family"], "full")
    assert both.filter("abs(predicted_sales - s) > 1e-5 OR s IS NULL OR predicted_sales IS NULL").isEmpty()


def test_retrained_tables_count_days_without_moving_them(tables):
    import re

    import shelfcast.plans.queries  # noqa: F401  (registers the queries)
    from shelfcast.plans.registry import QUERIES

    made = QUERIES["retrained_tables"].build(tables)
    assert not re.search(r"hashpartitioning\([^)]*date", made._jdf.queryExecution().executedPlan().toString())
    rows = {r["table_name"]: r for r in made.collect()}
    assert rows["forecasts"]["n_rows"] == rows["forecasts"]["n_keys"] == tables.plan.count()
    assert all(r["totals_agree"] for r in rows.values())
