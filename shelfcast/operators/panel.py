"""The family panel: one row per store, family and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.constants import NORMAL_DAY
from shelfcast.functions.expr import clipped
from shelfcast.functions.series import SERIES_KEYS, daily_spine
from shelfcast.operators.clean import (
    assert_unique,
    fill_promotion,
    remove_data_errors,
    with_quake_flag,
    with_target,
)
from shelfcast.operators.enrich import join_holidays, transactions_lag, with_item_columns

PANEL_KEYS = [*SERIES_KEYS, "date"]


def to_family(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Roll items up to families before any other join, so the dimension joins that
    follow touch panel rows instead of fact rows."""
    return (
        with_item_columns(sales, items, "family", "perishable")
        .groupBy(*PANEL_KEYS)
        .agg(
            F.sum("unit_sales").alias("unit_sales"),
            F.bool_or(F.col("onpromotion").cast("boolean")).alias("onpromotion"),
            F.max("perishable").alias("perishable"),
        )
    )


def attach_drivers(family_rows: DataFrame, stores: DataFrame, oil: DataFrame, holidays: DataFrame) -> DataFrame:
    """Store statics, oil price, holiday and quake flag of each panel row."""
    with_dims = family_rows.join(stores, "store_nbr", "left").join(oil, "date", "left")
    return with_quake_flag(join_holidays(with_dims, holidays)).drop("holiday_description")


def build_family_panel(
    sales: DataFrame,
    stores: DataFrame,
    items: DataFrame,
    oil: DataFrame,
    holidays: DataFrame,
    transactions: DataFrame,
) -> DataFrame:
    """Clean, roll up, enrich and attach yesterday's traffic; only days with sales."""
    cleaned = remove_data_errors(fill_promotion(sales))
    enriched = attach_drivers(to_family(cleaned, items), stores, oil, holidays)
    lagged = enriched.join(transactions_lag(transactions), ["store_nbr", "date"], "left")
    return with_target(lagged)


def future_skeleton(
    plan: DataFrame,
    stores: DataFrame,
    items: DataFrame,
    oil: DataFrame,
    holidays: DataFrame,
) -> DataFrame:
    """Plan rows as panel rows: target and traffic unknown, promotion known."""
    return future_rows(to_family(fill_promotion(plan).withColumn("unit_sales", F.lit(0.0)), items), stores, oil, holidays)


def future_rows(rolled: DataFrame, stores: DataFrame, oil: DataFrame, holidays: DataFrame) -> DataFrame:
    """Planned family days as panel rows."""
    return attach_drivers(rolled, stores, oil, holidays).withColumns(
        {
            "unit_sales": F.lit(None).cast("double"),
            "target": F.lit(None).cast("double"),
            "transactions_lag1": F.lit(None).cast("int"),
        }
    )


def _known(panel: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Known value of each column per key; the largest if a key has several, which unlike
    the first row's does not depend on row order.

    Distinct first: that is a hash aggregation, while a maximum of text would sort the panel.
    """
    values = panel.select(*keys, *columns).distinct()
    return values.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in columns])


def complete_panel(panel: DataFrame, check: bool = True) -> DataFrame:
    """Add the missing days of each series as zero sales, from its first day to the last
    day of the panel, and mark real days with `observed`.

    Columns of an added day come from the same store, series, store-day or date.  Store and
    series values are attached to the list of series, before it is spread over the days.
    """
    if check:
        assert_unique(panel, PANEL_KEYS, "complete_panel")
    have = set(panel.columns)
    by_store = [c for c in ("city", "state", "type", "cluster") if c in have]
    by_series = [c for c in ("perishable",) if c in have]
    by_store_day = [c for c in ("holiday_type", "transactions", "transactions_lag1") if c in have]

    last_day = panel.agg(F.max("date")).scalar()
    spans = [F.min("date").alias("_start"), *[F.max(c).alias(f"_{c}") for c in by_series]]
    names = panel.groupBy(*SERIES_KEYS).agg(*spans)
    if by_store:
        names = names.join(_known(panel, ["store_nbr"], by_store), "store_nbr", "left")
    statics = [f"_{c}" for c in [*by_series, *by_store]]
    grid = daily_spine(names, [*SERIES_KEYS, *statics], F.col("_start"), last_day)
    out = grid.join(panel.withColumn("observed", F.lit(True)), PANEL_KEYS, "left")
    filled = {"observed": F.coalesce("observed", F.lit(False))}
    filled |= {c: F.coalesce(c, f"_{c}") for c in [*by_series, *by_store]}

    if by_store_day:
        out = out.join(_known(panel, ["store_nbr", "date"], by_store_day), ["store_nbr", "date"], "left")
        filled |= {c: F.coalesce(c, f"_{c}") for c in by_store_day}
    day_columns = [c for c in ("oil_price", "is_earthquake_period", "holiday_type") if c in have]
    if day_columns:
        day_rows = []
        if "oil_price" in have:
            day_rows.append(F.max("oil_price").alias("_oil_price"))
            filled["oil_price"] = F.coalesce("oil_price", "_oil_price")
        if "is_earthquake_period" in have:
            day_rows.append(F.bool_or("is_earthquake_period").alias("_quake"))
            filled["is_earthquake_period"] = F.coalesce("is_earthquake_period", "_quake", F.lit(False))
        if "holiday_type" in have:
            # a day some other store marks as a holiday is one here too
            marked = F.when(F.col("holiday_type") != NORMAL_DAY, F.col("holiday_type"))
            day_rows.append(F.min(marked).alias("_day_holiday"))
            filled["holiday_type"] = F.coalesce(
                "holiday_type", "_holiday_type", "_day_holiday", F.lit(NORMAL_DAY)
            )
        by_day = panel.select("date", *day_columns).distinct().groupBy("date").agg(*day_rows)
        out = out.join(by_day, "date", "left")
    filled["target"] = clipped(F.coalesce("target", F.lit(0.0)))
    if "unit_sales" in have:
        filled["unit_sales"] = F.coalesce("unit_sales", F.lit(0.0))
    if "onpromotion" in have:
        filled["onpromotion"] = F.coalesce("onpromotion", F.lit(False))
    return out.withColumns(filled).select(*panel.columns, "observed")


def trim_warm_up(df: DataFrame, min_lag: int = 1, warm_up: int = 28) -> DataFrame:
    """Drop the first days of each series, where the longest look-back is not yet full."""
    days = max(warm_up, min_lag + 28)
    marked = df.withColumn("_first", F.min("date").over(Window.partitionBy(*SERIES_KEYS)))
    return marked.filter(F.col("date") >= F.date_add("_first", days)).drop("_first")
