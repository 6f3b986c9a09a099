"""Window helpers for daily series: one row per key and day, ordered by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES_KEYS = ["store_nbr", "family"]


def series(keys: list[str] | None = None, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or SERIES_KEYS)).orderBy(order)


def trailing(value: Column, stat, lag: int, width: int, need: int, over: WindowSpec) -> Column:
    """`stat` of the `width` rows that end `lag` rows back.

    Null unless at least `need` of them hold a value.
    """
    frame = over.rowsBetween(-(lag + width - 1), -lag)
    return F.when(F.count(value).over(frame) >= need, stat(value).over(frame))


def previous_value(value: Column, over: WindowSpec) -> Column:
    """Latest known value up to and including this row."""
    return F.last(value, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def next_value(value: Column, over: WindowSpec) -> Column:
    """First known value from this row on."""
    return F.first(value, ignorenulls=True).over(over.rowsBetween(0, Window.unboundedFollowing))


def daily_spine(df: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """One row per key and day between two date columns of `df`."""
    return df.select(*keys, F.explode(F.sequence(start, end)).alias("date"))
