"""Sums of the item forecast from pairs: the same as sums of the rows by day, without making or moving these."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import dashboards, forecast, inventory
from shelfcast.sources import raw
from shelfcast.sources import tables as sources

LAST = datetime.date(2020, 1, 31)
DAYS = [LAST + datetime.timedelta(days=k) for k in range(1, 5)]
PAIR = ["store_nbr", "item_nbr"]


@pytest.fixture
def small(spark):
    """Pairs with family and share (one pair twice, shares missing and below zero) and a forecast with a
    repeated day, one below zero and one beyond the horizon."""
    rows = [(1, 10, "a", 0.25), (1, 11, "a", 0.75), (1, 11, "b", 0.5), (2, 10, "a", None), (2, 12, None, 0.5), (3, 10, "a", -0.5), (3, 11, "a", 0.0)]
    pairs = forecast.number_pairs(spark.createDataFrame(rows, "store_nbr int, item_nbr long, family string, share double"))
    ahead = [(1, "a", DAYS[0], 8.0), (1, "a", DAYS[1], -2.0), (1, "a", LAST, 99.0), (1, "b", DAYS[0], 4.0), (1, "b", DAYS[0], 6.0)]
    ahead += [(2, "a", DAYS[2], 1.0), (3, "a", DAYS[0], 4.0), (3, "a", DAYS[1], -4.0), (3, "a", DAYS[3], None), (3, "a", DAYS[3] + datetime.timedelta(days=1), 77.0)]
    items = spark.createDataFrame([(10, "a"), (11, "a"), (11, "b")], "item_nbr long, family string")
    return pairs, spark.createDataFrame(ahead, "store_nbr int, family string, date date, prediction double"), items


def by_row(small):
    pairs, ahead, items = small
    return forecast.split_to_items(forecast.plan_days(pairs, F.lit(LAST), 4), items, ahead, None, ("family",))


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_totals_are_the_sums_of_the_split(small):
    got = forecast.split_totals(small[0], small[1], F.lit(LAST), 4)
    assert rows_of(inventory.demand(got)) == rows_of(inventory.demand(by_row(small).drop("family")))
    assert got.agg(F.sum("n_days")).first()[0] == by_row(small).count()
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_days_are_the_sums_of_the_split(small):
    keys = ["store_nbr", "family", "date"]
    total = F.round(F.sum("predicted_sales"), 9).alias("s")
    got = forecast.split_days(small[0], small[1], F.lit(LAST), 4)
    assert rows_of(got.groupBy(*keys).agg(total)) == rows_of(by_row(small).groupBy(*keys).agg(total))
    assert rows_of(dashboards.kpi(got)) == rows_of(dashboards.kpi(by_row(small)))
    kept = forecast.split_days(small[0].withColumn("name", F.lit("x")), small[1], F.lit(LAST), 4, ("name",))
    assert kept.select("name").distinct().count() == 1 and kept.count() == got.count()


def test_rows_in_order_are_those_of_a_sort(spark, small, tmp_path):
    pairs, ahead, items = small
    shares = spark.createDataFrame([], "store_nbr int, item_nbr long, share double")
    got, long = (forecast.split_in_order(pairs, items, ahead, shares, F.lit(LAST), 4, most) for most in (100, 0))
    assert rows_of(got) == rows_of(long) == rows_of(by_row(small).drop("family"))
    ids = [r["id"] for r in got.select("id").collect()]
    assert ids == sorted(ids) and len(set(ids)) < len(ids)
    # one sort of the pairs, none of the rows by day
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"rangepartitioning\(id", plan) and "rangepartitioning(pair_id" in plan
    sources.write_predictions(got, f"{tmp_path}/p", ordered=True)
    files = sorted(p for p in (tmp_path / "p").iterdir() if p.suffix == ".csv")
    written = [int(line.split(",")[0]) for p in files for line in p.read_text().splitlines()[1:]]
    assert written == ids


def test_many_pairs_stay_in_order(spark):
    pairs = forecast.number_pairs(spark.range(30000).select((F.col("id") % 7).cast("int").alias("store_nbr"), (F.col("id") * 7919 % 30011).alias("item_nbr")))
    pairs = pairs.withColumns({"family": F.lit("a"), "share": F.lit(0.1)}).repartition(5)
    ahead = spark.createDataFrame([(1, "a", d, 1.0) for d in DAYS], "store_nbr int, family string, date date, prediction double")
    ids = [r["id"] for r in forecast.split_in_order(pairs, None, ahead, None, F.lit(LAST), 4).select("id").collect()]
    assert ids == sorted(ids) and len(ids) == 120000


def test_load_by_pair_is_the_load_by_row(spark):
    pairs = forecast.number_pairs(spark.createDataFrame([(1, 10), (1, 2**36), (2**19, 3)], "store_nbr int, item_nbr long"))
    plan = forecast.plan_days(pairs, F.lit(LAST), 4)
    ids = [r["id"] for r in plan.collect()]
    # repeated, unknown, beyond the horizon, before it, negative and missing
    odd = [ids[0], ids[0] + 1, ids[0] + (4 << 57), ids[0] - (1 << 57), -5, None, 0]
    some = spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids + odd)], "id long, unit_sales double")
    columns = ["id", "predicted_sales", "store_nbr", "item_nbr", "date"]
    got = raw.load_forecasts([None, some], pairs, F.lit(LAST), 4).select(*columns)
    assert rows_of(got) == rows_of(raw.load_forecasts([some], plan).select(*columns))
    assert got.schema.simpleString() == raw.load_forecasts([some], plan).select(*columns).schema.simpleString()


def test_comparison_by_pair_counts_as_a_full_join(spark):
    schema = "store_nbr int, item_nbr long, date date"
    off = LAST - datetime.timedelta(days=3)
    planned = [(1, 10, DAYS[0]), (1, 10, DAYS[0]), (1, 10, DAYS[1]), (1, 11, DAYS[0]), (2, 10, off), (2, 10, None), (None, 10, DAYS[0]), (1, 12, LAST)]
    made = [(1, 10, DAYS[0]), (1, 10, DAYS[0]), (1, 10, DAYS[0]), (1, 10, DAYS[3]), (2, 10, off), (2, 10, off), (2, 10, None), (None, 10, DAYS[0]), (1, 12, DAYS[0])]
    a, b = spark.createDataFrame(planned, schema), spark.createDataFrame(made, schema)
    keys = [*PAIR, "date"]
    both = a.withColumn("p", F.lit(1)).join(b.withColumn("m", F.lit(1)), keys, "full")
    lacks = lambda c: F.count(F.when(F.col(c).isNull(), 1))
    want = both.agg(F.count("p").alias("planned"), F.count("m").alias("made"), lacks("m").alias("missing"), lacks("p").alias("not_planned"))
    got = forecast.compared_by_pair(a, b, F.lit(LAST), 4)
    assert got.first() == want.first()
    assert forecast.compared_by_pair(a.limit(0), b.limit(0), F.lit(LAST), 4).first() == (0, 0, 0, 0)


def test_queries_sum_pairs(tables):
    """The tables and questions that sum the item forecast never spread its pairs, and agree with its rows."""
    total = tables.forecasts.agg(F.count(F.lit(1)), F.sum("predicted_sales")).first()
    pairs = tables.forecast_totals.agg(F.sum("n_days"), F.sum("predicted_sales")).first()
    days = tables.forecast_days.agg(F.count_distinct("date"), F.sum("predicted_sales")).first()
    assert pairs[0] == total[0] and days[0] == tables.horizon
    assert pairs[1] == pytest.approx(total[1], rel=1e-12) and days[1] == pytest.approx(total[1], rel=1e-12)
    assert tables.forecasts_in_order.count() == total[0]
