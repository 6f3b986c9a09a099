"""One key holds more than a third of the rows: results stay whole and the key is split."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.ranking import top_k
from shelfcast.operators import aggregates, clean, enrich, text

ROWS = 40_000
HOT = 11


@contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


SHUFFLE_ONLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
}


@pytest.fixture(scope="module")
def hot_sales(spark, tmp_path_factory):
    i = F.col("id")
    rows = spark.range(ROWS, numPartitions=16).select(
        F.date_add(F.lit(date(2017, 1, 1)), (i % 90).cast("int")).alias("date"),
        F.when(i % 5 < 2, 1).otherwise((i % 20).cast("int")).alias("store_nbr"),
        F.when(i % 3 == 0, HOT).otherwise(i % 500).alias("item_nbr"),
        F.when(i % 97 == 0, -(i % 50)).otherwise(i % 13).cast("double").alias("unit_sales"),
        F.when(i % 4 == 0, None).otherwise(i % 2).cast("int").alias("onpromotion"),
        F.xxhash64("id").alias("payload"),
    )
    path = str(tmp_path_factory.mktemp("hot") / "sales")
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def items(spark):
    return spark.range(500).select(
        F.col("id").alias("item_nbr"),
        F.when(F.col("id") == HOT, "HOT").otherwise(F.concat(F.lit("F"), (F.col("id") % 7).cast("string"))).alias("family"),
        (F.col("id") % 2).cast("int").alias("perishable"),
    )


def test_hot_item_is_split_in_the_dimension_join(spark, hot_sales, items):
    with settings(spark, **SHUFFLE_ONLY):
        joined = enrich.with_item_columns(hot_sales, items, "family", "perishable")
        assert joined.count() == ROWS
        got = joined.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("unit_sales").alias("s"))
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    families = items.toPandas().set_index("item_nbr").family
    want = hot_sales.toPandas().assign(family=lambda p: p.item_nbr.map(families)).groupby("family").unit_sales.agg(["size", "sum"])
    assert {r["family"]: (r["n"], r["s"]) for r in got.collect()} == {k: (v["size"], v["sum"]) for k, v in want.iterrows()}


def test_error_removal_keeps_every_other_row(spark, hot_sales):
    p = hot_sales.toPandas()
    top = p.groupby("item_nbr").unit_sales.transform("max")
    bad = (p.unit_sales < 0) & (p.unit_sales.abs() > top)
    assert 0 < bad.sum() < len(p)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        kept = clean.remove_data_errors(hot_sales)
        assert kept.count() == len(p) - bad.sum()
        assert kept.agg(F.sum("unit_sales")).first()[0] == p[~bad].unit_sales.sum()


def test_cube_is_whole(spark, hot_sales, items):
    sales = hot_sales.withColumn("onpromotion", F.coalesce("onpromotion", F.lit(0)))
    cube = aggregates.daily_cube(sales, items)
    assert cube.agg(F.sum("n_rows"), F.sum("units")).first() == hot_sales.agg(F.count(F.lit(1)), F.sum("unit_sales")).first()
    promo = aggregates.promotions_of(cube)
    assert promo.agg(F.sum("item_day_rows")).first()[0] == ROWS


def test_top_k_of_a_hot_store(hot_sales):
    per_item = hot_sales.groupBy("store_nbr", "item_nbr").agg(F.sum("unit_sales").alias("u"))
    got = top_k(per_item, ["store_nbr"], [F.desc("u"), F.col("item_nbr")], 3)
    p = per_item.toPandas().sort_values(["store_nbr", "u", "item_nbr"], ascending=[True, False, True])
    want = p.groupby("store_nbr").head(3)
    assert {(r["store_nbr"], r["item_nbr"]) for r in got.collect()} == set(zip(want.store_nbr, want.item_nbr))


def test_one_conversation_with_most_turns(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") < 25_000, 1).otherwise(F.col("id")).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("text"),
    )
    assert text.sanitize_history(rows).count() == 30_000
    kept = text.sanitize_history(rows, max_messages=40)
    assert kept.filter("conv_id = 1").agg(F.min("turn"), F.max("turn")).first() == (24_960, 24_999)
    assert kept.filter("conv_id > 1").count() == 5000
    fitting = text.trim_to_budget(text.sanitize_history(rows), 30).filter("conv_id = 1")
    assert fitting.agg(F.max("turn"), F.sum("tokens")).first() == (24_999, 30)


def test_series_completion_counts_days(spark):
    """A panel in which one series has nearly all rows."""
    from shelfcast.operators.panel import complete_panel

    start = date(2016, 1, 1)
    rows = [(1, "A", start + timedelta(days=i), 1.0) for i in range(400)] + [(s, "B", start + timedelta(days=399), 2.0) for s in range(2, 9)]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date date, target double")
    assert complete_panel(df).count() == 407
