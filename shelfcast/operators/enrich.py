"""Joins that attach dimensions, prices, holidays and calendars.

No join carries a broadcast hint: Spark broadcasts a side only when its measured size is
under the session threshold, and otherwise shuffles with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import (
    COASTAL_SCHOOL_MONTHS,
    COASTAL_STATES,
    DEFAULT_COST_RATIO,
    DEFAULT_PRICE,
    DEFAULT_RETURN_RATE,
    INLAND_SCHOOL_MONTHS,
    NO_HOLIDAY,
    NORMAL_DAY,
    TIER1_CLUSTERS,
)
from shelfcast.functions.series import series


def star(sales: DataFrame, stores: DataFrame, items: DataFrame, oil: DataFrame) -> DataFrame:
    """Facts with store, item and oil columns; no fact row is lost."""
    return (
        sales.join(stores, "store_nbr", "left").join(items, "item_nbr", "left").join(oil, "date", "left")
    )


def with_item_columns(sales: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """Sales with item attributes; no join when the sales already carry them.

    Items outside the catalogue keep their rows, with nulls.
    """
    missing = [c for c in columns if c not in sales.columns]
    return sales.join(items.select("item_nbr", *missing), "item_nbr", "left") if missing else sales


def join_holidays(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """National, then regional (by state), then local (by city) holiday of each row.

    Every level is reduced to one row per key first, so no input row is repeated.  Among
    duplicates the alphabetically first (type, description) is kept.
    """

    def level(locale: str, keys: dict[str, str], tag: str) -> DataFrame:
        picked = F.min(F.struct("holiday_type", "holiday_description"))
        rows = holidays.filter(F.col("locale") == locale)
        rows = rows.select(
            *[F.col(src).alias(dst) for src, dst in keys.items()], "holiday_type", "holiday_description"
        )
        return rows.groupBy(*keys.values()).agg(picked.alias(tag))

    joined = (
        df.join(level("National", {"date": "date"}, "_nat"), "date", "left")
        .join(level("Regional", {"date": "date", "locale_name": "state"}, "_reg"), ["date", "state"], "left")
        .join(level("Local", {"date": "date", "locale_name": "city"}, "_loc"), ["date", "city"], "left")
    )

    def first_of(field: str, default: str):
        levels = [F.col(f"{t}.{field}") for t in ("_nat", "_reg", "_loc")]
        return F.coalesce(*levels, F.lit(default))

    return joined.withColumns(
        {
            "holiday_type": first_of("holiday_type", NORMAL_DAY),
            "holiday_description": first_of("holiday_description", NO_HOLIDAY),
        }
    ).drop("_nat", "_reg", "_loc")


def transactions_lag(transactions: DataFrame, days: int = 1) -> DataFrame:
    """Store traffic of `days` rows before, computed on the small store-day table."""
    over = series(["store_nbr"])
    return transactions.select(
        "store_nbr", "date", F.lag("transactions", days).over(over).alias(f"transactions_lag{days}")
    )


def join_prices(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Price, cost ratio and return rate by family in any case; defaults for unknown families."""
    keyed = prices.select(
        F.upper("family").alias("_family"), "unit_price", "cost_ratio", "return_rate"
    )
    joined = df.join(keyed, F.upper(F.coalesce("family", F.lit(""))) == F.col("_family"), "left")
    return joined.withColumns(
        {
            "unit_price": F.coalesce("unit_price", F.lit(DEFAULT_PRICE)),
            "cost_ratio": F.coalesce("cost_ratio", F.lit(DEFAULT_COST_RATIO)),
            "return_rate": F.coalesce("return_rate", F.lit(DEFAULT_RETURN_RATE)),
        }
    ).drop("_family")


def with_date_parts(df: DataFrame) -> DataFrame:
    """Day of week (Monday 0), month and weekend flag."""
    day = F.weekday("date")
    return df.withColumns(
        {"dayofweek": day, "month": F.month("date"), "is_weekend": day.isin(5, 6).cast("int")}
    )


def with_calendar(df: DataFrame) -> DataFrame:
    """Month position and pay-day distance; wages are paid on the 15th and at month end."""
    day = F.dayofmonth("date")
    length = F.dayofmonth(F.last_day("date"))
    last_pay = F.when(day >= 15, 15).otherwise(0)
    next_pay = F.when(day < 15, 15).otherwise(length)
    return df.withColumns(
        {
            "dayofmonth": day,
            "weekofmonth": (F.floor((day - 1) / 7) + 1).cast("int"),
            "dayofyear": F.dayofyear("date"),
            "is_payday": ((day == 15) | (day == length)).cast("int"),
            "is_day_after_payday": day.isin(1, 16).cast("int"),
            "days_from_payday": day - last_pay,
            "days_to_payday": next_pay - day,
            "is_month_start": (day <= 3).cast("int"),
            "is_month_end": (length - day <= 2).cast("int"),
        }
    )


def with_back_to_school(df: DataFrame, coastal_states: list[str] | None = None) -> DataFrame:
    """School season: spring on the coast, late summer elsewhere."""
    coast = F.coalesce(F.col("state").isin(coastal_states or COASTAL_STATES), F.lit(False))
    month = F.month("date")
    season = (coast & month.isin(COASTAL_SCHOOL_MONTHS)) | (~coast & month.isin(INLAND_SCHOOL_MONTHS))
    return df.withColumn("is_back_to_school", season.cast("int"))


def with_tier_flag(df: DataFrame) -> DataFrame:
    tier1 = F.coalesce(F.col("cluster").isin(TIER1_CLUSTERS), F.lit(False))
    return df.withColumn("is_tier1_cluster", tier1.cast("int"))


def split_by_tier(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tier 1 clusters and all others."""
    flagged = with_tier_flag(df)
    keep = flagged.columns[:-1]
    return (
        flagged.filter("is_tier1_cluster = 1").select(*keep),
        flagged.filter("is_tier1_cluster = 0").select(*keep),
    )
