"""Cleaning, guards and small repairs on sales and driver series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.constants import QUAKE_WORD
from shelfcast.functions.expr import clipped
from shelfcast.functions.series import next_value, previous_value


def from_date(df: DataFrame, start: str) -> DataFrame:
    return df.filter(F.col("date") >= F.lit(start).cast("date"))


def fill_promotion(df: DataFrame) -> DataFrame:
    """A missing promotion flag means no promotion."""
    return df.withColumn("onpromotion", F.coalesce(F.col("onpromotion").cast("boolean"), F.lit(False)))


def _error_rows(sales: DataFrame) -> DataFrame:
    """Negative rows joined to their item's largest sale.

    Only negative rows meet the join, so the bulk of the facts is never shuffled.
    """
    item_max = sales.groupBy("item_nbr").agg(F.max("unit_sales").alias("_item_max"))
    return sales.filter(F.col("unit_sales") < 0).join(item_max, "item_nbr")


def remove_data_errors(sales: DataFrame) -> DataFrame:
    """Drop rows sold below zero by more than the item ever sold in a row."""
    kept_negative = (
        _error_rows(sales).filter(F.abs("unit_sales") <= F.col("_item_max")).select(*sales.columns)
    )
    rest = sales.filter((F.col("unit_sales") >= 0) | F.col("unit_sales").isNull())
    return rest.unionByName(kept_negative)


def data_error_count(sales: DataFrame) -> DataFrame:
    """How many rows `remove_data_errors` drops."""
    return _error_rows(sales).agg(
        F.count(F.lit(1)).alias("negative_rows"),
        F.count_if(F.abs("unit_sales") > F.col("_item_max")).alias("removed_rows"),
    )


def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", clipped("unit_sales"))


def fill_daily(oil: DataFrame, column: str, out: str, low=None, high=None) -> DataFrame:
    """Gap-free daily series: forward fill, then backward fill for a leading gap.

    `low` and `high` are date columns or literals; by default the range of the input.
    The series has one row per calendar day, so one ordered window over it stays small.
    """
    bounds = oil.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo = F.col("lo") if low is None else low
    hi = F.col("hi") if high is None else high
    spine = bounds.select(F.explode(F.sequence(lo, hi)).alias("date"))
    over = Window.orderBy("date")
    filled = spine.join(oil.select("date", column), "date", "left").withColumn(
        "_forward", previous_value(F.col(column), over)
    )
    return filled.select("date", F.coalesce("_forward", next_value(F.col(column), over)).alias(out))


def prepare_holidays(holidays: DataFrame) -> DataFrame:
    """Days really observed: a transferred day is an ordinary one."""
    return holidays.filter(~F.col("transferred")).select(
        "date",
        "locale",
        "locale_name",
        F.col("type").alias("holiday_type"),
        F.col("description").alias("holiday_description"),
    )


def with_quake_flag(df: DataFrame) -> DataFrame:
    found = F.lower("holiday_description").contains(QUAKE_WORD)
    return df.withColumn("is_earthquake_period", F.coalesce(found, F.lit(False)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: list[str], who: str) -> None:
    """Fail loudly on duplicate keys (runs a job)."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{who}: duplicate rows for {keys}")


def gap_report(panel: DataFrame, keys: list[str], tolerance: float = 0.95) -> DataFrame:
    """Rows against the day span of each series, flagged below `tolerance`."""
    spans = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("span_days"),
    )
    return spans.withColumn("has_gaps", F.col("n_days") < F.col("span_days") * tolerance)


def observed_only(df: DataFrame) -> DataFrame:
    """Days really sold, without the injected zero days."""
    return df.filter(F.col("observed"))


def stack(history: DataFrame, future: DataFrame) -> DataFrame:
    """History and future rows under one schema; columns one side lacks are null."""
    return history.unionByName(future, allowMissingColumns=True)


def forward_fill(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Carry the last known value of each column forward by date inside each key.

    Meant for small driver tables (one row per key and day).
    """
    over = Window.partitionBy(*keys).orderBy("date")
    return df.withColumns({c: previous_value(F.col(c), over) for c in columns})
