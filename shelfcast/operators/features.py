"""Lag, rolling and cross-series features of a completed panel.

Row shifts equal day shifts only on a panel without gaps, so call `complete_panel` first.
All series windows share one partitioning and order, hence one exchange and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.constants import (
    DAYS_SINCE_SALE_CAP,
    LOG_LAGS,
    LOG_MEAN_WINDOWS,
    NORMAL_DAY,
    SALES_LAGS,
    SALES_MEAN_WINDOWS,
    SALES_STD_WINDOWS,
)
from shelfcast.functions.expr import log_target, require_columns
from shelfcast.functions.running import running_total
from shelfcast.functions.series import SERIES_KEYS, series, trailing
from shelfcast.operators.encoding import ClusterEncoding
from shelfcast.operators.enrich import with_back_to_school, with_calendar, with_date_parts, with_tier_flag

# real look-back in days of the base features, for choosing features by safe lag
BASE_FEATURE_LAGS = {
    "sales_lag7": 7,
    "sales_lag14": 14,
    "sales_lag28": 28,
    "sales_rolling_mean7": 1,
    "sales_rolling_mean14": 1,
    "sales_rolling_mean30": 1,
    "sales_std7": 1,
    "sales_std28": 1,
    "transactions_lag1": 1,
}
CLUSTER_FEATURES = [
    "cluster_mean_sales",
    "cluster_median_sales",
    "cluster_std_sales",
    "cluster_family_mean_sales",
    "cluster_promo_mean_sales",
    "cluster_promo_lift",
    "is_tier1_cluster",
]
CATEGORIES = ["store_nbr", "family", "city", "state", "type", "holiday_type"]
CALENDAR_FEATURES = [
    "dayofmonth",
    "weekofmonth",
    "dayofyear",
    "is_payday",
    "is_day_after_payday",
    "days_from_payday",
    "days_to_payday",
    "is_month_start",
    "is_month_end",
]
DRIVER_FEATURES = [
    "dayofweek",
    "month",
    "is_weekend",
    "oil_price",
    "cluster",
    "perishable",
    "is_holiday",
    "is_holiday_lag1",
    "is_holiday_lag2",
    "is_holiday_lead1",
    "is_holiday_lead2",
    "onpromotion",
    "is_earthquake_period",
    "is_back_to_school",
]
CROSS_FEATURES = ["store_promo_share", "store_slog_mean_lag", "family_slog_mean_lag"]


def base_features(panel: DataFrame, encoding: ClusterEncoding | None = None) -> DataFrame:
    """Calendar, sales lag and rolling features, holiday neighbourhood, optional encoding."""
    require_columns(panel, [*SERIES_KEYS, "date", "target", "holiday_type"], "base_features")
    df = panel.withColumns(
        {
            "onpromotion": F.coalesce(F.col("onpromotion").cast("int"), F.lit(0)),
            "is_earthquake_period": F.coalesce(F.col("is_earthquake_period").cast("int"), F.lit(0)),
            "is_holiday": (F.col("holiday_type") != NORMAL_DAY).cast("int"),
        }
    )
    df = with_back_to_school(with_calendar(with_date_parts(df)))
    over, y, off = series(), F.col("target"), F.col("is_holiday")
    made = {f"sales_lag{k}": F.lag(y, k).over(over) for k in SALES_LAGS}
    made |= {f"sales_rolling_mean{w}": trailing(y, F.avg, 1, w, w, over) for w in SALES_MEAN_WINDOWS}
    made |= {f"sales_std{w}": trailing(y, F.stddev_samp, 1, w, w, over) for w in SALES_STD_WINDOWS}
    made |= {f"is_holiday_lag{k}": F.coalesce(F.lag(off, k).over(over), F.lit(0)) for k in (1, 2)}
    made |= {f"is_holiday_lead{k}": F.coalesce(F.lead(off, k).over(over), F.lit(0)) for k in (1, 2)}
    df = df.withColumns(made)
    if encoding is not None:
        df = encoding.apply(df)
    return with_tier_flag(df)


def extended_names(min_lag: int = 1, traffic: bool = True, cross: bool = False) -> list[str]:
    """Names the extended block creates, in order."""
    lags = sorted({max(k, min_lag) for k in LOG_LAGS})
    names = [f"slog_lag{k}" for k in lags]
    names += [f"slog_roll_mean{w}" for w in LOG_MEAN_WINDOWS]
    names += ["slog_roll_std7", "slog_roll_std28", "slog_dow_mean4", "slog_trend_7_28", "slog_ratio_7_28"]
    names += ["zero_rate_7", "zero_rate_28", "days_since_sale", "promo_rate_7", "promo_rate_28"]
    names += CALENDAR_FEATURES
    names += ["trans_roll_mean7"] if traffic else []
    return names + (CROSS_FEATURES if cross else [])


def _cross_series(df: DataFrame, min_lag: int) -> DataFrame:
    """Store-day and family-day means, lagged on the small aggregates and joined back."""
    by_store = df.groupBy("store_nbr", "date").agg(
        F.avg("_slog").alias("_mean"), F.avg("_promo").alias("store_promo_share")
    )
    by_store = by_store.select(
        "store_nbr",
        "date",
        "store_promo_share",
        F.lag("_mean", min_lag).over(series(["store_nbr"])).alias("store_slog_mean_lag"),
    )
    by_family = df.groupBy("family", "date").agg(F.avg("_slog").alias("_mean"))
    by_family = by_family.select(
        "family", "date", F.lag("_mean", min_lag).over(series(["family"])).alias("family_slog_mean_lag")
    )
    return df.join(by_store, ["store_nbr", "date"], "left").join(by_family, ["family", "date"], "left")


def traffic_mean(transactions: DataFrame, min_lag: int = 1) -> DataFrame:
    """Seven-day mean of store traffic, on the store-day table."""
    over = series(["store_nbr"])
    return transactions.select(
        "store_nbr",
        "date",
        trailing(F.col("transactions"), F.avg, min_lag, 7, 2, over).alias("trans_roll_mean7"),
    )


def extended_features(df: DataFrame, min_lag: int = 1, cross: bool = False) -> DataFrame:
    """Log-space lags and rolling statistics that never look closer than `min_lag` days.

    Columns of an earlier run are replaced.  Doubles stay doubles; cast to float only at a
    model boundary.
    """
    require_columns(df, [*SERIES_KEYS, "date", "target"], "extended_features")
    stale = {*extended_names(min_lag, cross=True), *(f"slog_lag{k}" for k in LOG_LAGS)}
    df = df.drop(*(c for c in stale if c in df.columns))

    promo = F.col("onpromotion").cast("double") if "onpromotion" in df.columns else F.lit(None).cast("double")
    df = df.withColumns(
        {
            "_slog": log_target("target"),
            "_zero": (F.col("target") <= 0).cast("double"),
            "_promo": F.coalesce(promo, F.lit(0.0)) if "onpromotion" in df.columns else promo,
            "_sold": F.when(F.col("target") > 0, F.col("date")),
            "_dow": F.weekday("date"),
        }
    )
    over, lag = series(), min_lag
    slog, zero, promo = F.col("_slog"), F.col("_zero"), F.col("_promo")
    made = {f"slog_lag{k}": F.lag(slog, k).over(over) for k in sorted({max(k, lag) for k in LOG_LAGS})}
    made |= {
        f"slog_roll_mean{w}": trailing(slog, F.avg, lag, w, max(2, w // 3), over) for w in LOG_MEAN_WINDOWS
    }
    made["slog_roll_std7"] = trailing(slog, F.stddev_samp, lag, 7, 3, over)
    made["slog_roll_std28"] = trailing(slog, F.stddev_samp, lag, 28, 7, over)
    made["zero_rate_7"] = trailing(zero, F.avg, lag, 7, 2, over)
    made["zero_rate_28"] = trailing(zero, F.avg, lag, 28, 7, over)
    made["promo_rate_7"] = trailing(promo, F.avg, lag, 7, 2, over)
    made["promo_rate_28"] = trailing(promo, F.avg, lag, 28, 7, over)
    until_lag = over.rowsBetween(Window.unboundedPreceding, -lag)
    made["_last_sale"] = F.last("_sold", ignorenulls=True).over(until_lag)
    df = df.withColumns(made)

    weeks = math.ceil(lag / 7)
    df = df.withColumns(
        {
            "slog_dow_mean4": trailing(slog, F.avg, weeks, 4, 1, series([*SERIES_KEYS, "_dow"])),
            "slog_trend_7_28": F.col("slog_roll_mean7") - F.col("slog_roll_mean28"),
            "slog_ratio_7_28": F.col("slog_roll_mean7") / (F.col("slog_roll_mean28") + 1e-3),
            "days_since_sale": F.least(
                F.coalesce(F.datediff("date", "_last_sale"), F.lit(DAYS_SINCE_SALE_CAP)),
                F.lit(DAYS_SINCE_SALE_CAP),
            ),
        }
    )
    if cross:
        df = _cross_series(df, lag)
    if "transactions" in df.columns:
        store_days = df.groupBy("store_nbr", "date").agg(
            F.first("transactions", ignorenulls=True).alias("transactions")
        )
        df = df.join(traffic_mean(store_days, lag), ["store_nbr", "date"], "left")
    return with_calendar(df).drop("_slog", "_zero", "_promo", "_sold", "_dow", "_last_sale")


def impute(df: DataFrame, min_lag: int = 1) -> DataFrame:
    """0 for base lags and encodings, -1 for extended features."""
    zero = [c for c in [*BASE_FEATURE_LAGS, *CLUSTER_FEATURES] if c in df.columns]
    minus = [c for c in extended_names(min_lag, cross=True) if c in df.columns and c not in zero]
    filled = {c: F.coalesce(c, F.lit(0)) for c in zero}
    filled |= {c: F.coalesce(c, F.lit(-1)) for c in minus}
    return df.withColumns(filled)


def encode_ordinal(train: DataFrame, df: DataFrame, columns: list[str], unknown: int = 9999) -> DataFrame:
    """Alphabetical code per category seen in `train`; `unknown` for all others.

    Codes come from the distinct values, so the table that is ordered is a dictionary, not
    the facts; it is numbered in range partitions, whatever its length.
    """
    for c in columns:
        values = train.select(c).filter(F.col(c).isNotNull()).distinct().withColumn("_one", F.lit(1))
        numbered = running_total(values, [], [F.col(c)], "_one", "_upto")
        codes = numbered.select(c, (F.col("_upto") - 1).cast("int").alias("_code"))
        df = df.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce("_code", F.lit(unknown))).drop("_code")
    return df


def select_features(columns: list[str], min_lag: int, cross: bool = False) -> dict[str, list[str]]:
    """Feature groups that are safe at `min_lag`, without repeats.

    A base feature whose real look-back is shorter than `min_lag` would show the model a
    day it cannot know, so it is left out and reported.
    """
    have = set(columns)
    safe = [c for c, lag in BASE_FEATURE_LAGS.items() if lag >= min_lag and c in have]
    groups = {
        "zero_filled": safe + [c for c in CLUSTER_FEATURES if c in have],
        "sentinel_filled": [c for c in extended_names(min_lag, "transactions" in have, cross) if c in have],
        "categories": [c for c in CATEGORIES if c in have],
        "passed_through": [c for c in DRIVER_FEATURES if c in have],
    }
    seen: set[str] = set()
    for name, members in groups.items():
        groups[name] = [c for c in members if not (c in seen or seen.add(c))]
    groups["dropped_for_lag"] = [c for c, lag in BASE_FEATURE_LAGS.items() if lag < min_lag]
    return groups
