"""Top-k per group.

`row_number() <= k` is planned with a map-side group limit, so each map task sends at
most k rows of a group: a group that holds a third of all rows is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    over = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(over)).filter(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`."""
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def top_overall(df: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows with their rank; only those k rows meet in one task."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))
