"""Small serving tables built once from the facts and read by the questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.constants import DEFAULT_FAMILY_RMSLE, SHARE_LOOKBACK_DAYS
from shelfcast.functions.expr import clipped, grade
from shelfcast.functions.running import exact_median, running_total
from shelfcast.operators.enrich import join_prices, with_item_columns


def item_store_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy("store_nbr", "item_nbr").agg(F.sum("unit_sales").alias("unit_sales"))


def forecast_by_family(forecasts: DataFrame, items: DataFrame) -> DataFrame:
    """Forecast per store, day and family; items are joined unless the forecasts carry their family."""
    joined = forecasts if "family" in forecasts.columns else forecasts.join(items.select("item_nbr", "family"), "item_nbr")
    return joined.groupBy("store_nbr", "date", "family").agg(
        grade(F.sum("predicted_sales")).alias("predicted_sales")
    )


def daily_cube(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Rows and units per (day, store, family, perishable, promotion flag).

    One pass over the facts feeds business figures, promotion statistics and history.
    """
    return (
        with_item_columns(sales, items, "family", "perishable")
        .groupBy("date", "store_nbr", "family", "perishable", "onpromotion")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("unit_sales").alias("units"))
    )


def business_of(cube: DataFrame, prices: DataFrame) -> DataFrame:
    """Revenue, returns and cost of goods by day and store; cost counts net units only."""
    by_family = cube.groupBy("date", "store_nbr", "family").agg(F.sum("units").alias("_units"))
    priced = join_prices(by_family, prices)
    gross = F.col("_units") * F.col("unit_price")
    returned = gross * F.col("return_rate")
    cost = F.col("_units") * (1 - F.col("return_rate")) * F.col("unit_price") * F.col("cost_ratio")
    return priced.groupBy("date", "store_nbr").agg(
        F.sum(gross).alias("revenue"), F.sum(returned).alias("returns"), F.sum(cost).alias("cogs")
    )


def daily_business(sales: DataFrame, items: DataFrame, prices: DataFrame) -> DataFrame:
    return business_of(daily_cube(sales, items), prices)


def promotions_of(cube: DataFrame) -> DataFrame:
    """Item-day rows, units and distinct days per (store, family, promotion flag).

    Rows are first reduced to days, which makes the distinct count a plain count.
    """
    keys = ["store_nbr", "family", "onpromotion"]
    known = cube.filter(F.col("family").isNotNull())
    by_day = known.groupBy(*keys, "date").agg(F.sum("n_rows").alias("_rows"), F.sum("units").alias("_units"))
    return by_day.groupBy(*keys).agg(
        F.sum("_rows").alias("item_day_rows"),
        F.sum("_units").alias("total_units"),
        F.count(F.lit(1)).alias("promo_days"),
    )


def promo_family_stats(sales: DataFrame, items: DataFrame) -> DataFrame:
    return promotions_of(daily_cube(sales, items))


def history_of(cube: DataFrame) -> DataFrame:
    """Units by day, family and perishable flag."""
    known = cube.filter(F.col("family").isNotNull())
    return known.groupBy("date", "family", "perishable").agg(F.sum("units").alias("unit_sales"))


def item_windows(sales: DataFrame, year: int, last_day: Column, days: int = SHARE_LOOKBACK_DAYS) -> DataFrame:
    """Four sums per item in one pass: one year, all time, the last window, the one before."""
    units, day = F.col("unit_sales"), F.col("date")
    recent = day > F.date_sub(last_day, days)
    before = (day > F.date_sub(last_day, 2 * days)) & ~recent

    def total(condition):
        return F.sum(F.when(condition, units).otherwise(0.0))

    return sales.groupBy("item_nbr").agg(
        total(F.year(day) == year).alias("sold_year"),
        F.sum(units).alias("hist_total"),
        total(before).alias("w0_total"),
        total(recent).alias("w1_total"),
    )


def abc_classes(
    totals: DataFrame,
    value: str,
    group: list[str] | None = None,
    key: str = "item_nbr",
    a: float = 0.80,
    b: float = 0.95,
) -> DataFrame:
    """ABC class by cumulative share of `value`, largest first, ties by key.

    Works chain-wide (no group) and per store on catalogues of any size.
    """
    order = [F.col(value).desc(), F.col(key)]
    ranked = running_total(totals, group or [], order, value, "cum_value", "total_value")
    cum, whole = F.col("cum_value"), F.col("total_value")
    return ranked.withColumn(
        "abc_class", F.when(cum <= a * whole, "A").when(cum <= b * whole, "B").otherwise("C")
    )


def sku_stats(
    sales: DataFrame,
    items: DataFrame,
    forecasts: DataFrame,
    year: int,
    last_day: Column,
    family_errors: DataFrame | None = None,
    days: int = SHARE_LOOKBACK_DAYS,
) -> DataFrame:
    """One row per catalogue item: history sums, recent rate, forecast, class, family error."""
    windows = item_windows(sales, year, last_day, days)
    classes = abc_classes(windows.select("item_nbr", "hist_total"), "hist_total").select("item_nbr", "abc_class")
    ahead = forecasts.groupBy("item_nbr").agg(F.sum("predicted_sales").alias("fc_total_16d"))
    out = (
        items.select("item_nbr", "family", F.col("class").alias("class_code"), "perishable")
        .join(windows, "item_nbr", "left")
        .join(ahead, "item_nbr", "left")
        .join(classes, "item_nbr", "left")
    )
    if family_errors is None:
        out = out.withColumn("family_rmsle", F.lit(None).cast("double"))
    else:
        out = out.join(family_errors.select("family", "family_rmsle"), "family", "left")
    zero = F.lit(0.0)
    return out.select(
        "item_nbr",
        "family",
        "class_code",
        "perishable",
        F.coalesce("sold_year", zero).alias("sold_year"),
        F.coalesce("hist_total", zero).alias("hist_total"),
        (F.coalesce("w1_total", zero) / days).alias("avg_daily_45d"),
        F.coalesce("w0_total", zero).alias("w0_total"),
        F.coalesce("w1_total", zero).alias("w1_total"),
        F.coalesce("fc_total_16d", zero).alias("fc_total_16d"),
        F.coalesce("abc_class", F.lit("C")).alias("abc_class"),
        F.coalesce("family_rmsle", F.lit(DEFAULT_FAMILY_RMSLE)).alias("family_rmsle"),
    )


def stability_by_class(stats: DataFrame) -> DataFrame:
    """Change of the last window against the one before, summarised per ABC class."""
    moved = stats.filter(F.col("w0_total") > 0).select(
        "abc_class", ((F.col("w1_total") - F.col("w0_total")) / F.col("w0_total") * 100.0).alias("dev")
    )
    summary = moved.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("dev")).alias("mean_abs_dev_pct"),
        F.avg(F.when(F.abs("dev") <= 30, 100.0).otherwise(0.0)).alias("pct_within_30"),
    )
    medians = exact_median(moved, ["abc_class"], "dev", "median_dev_pct", upper=True)
    return summary.join(medians, "abc_class")


def item_shares(
    sales: DataFrame,
    items: DataFrame,
    last_day: Column,
    days: int = SHARE_LOOKBACK_DAYS,
    year_ago_weight: float = 0.0,
    by_sum: bool = False,
) -> DataFrame:
    """Share of each item in its family per store, from mean units per sold row.

    `by_sum` uses window totals instead of means; `year_ago_weight` blends in the same
    window one year before.  Family totals are joined back from an aggregate, so no
    window gathers a hot family.
    """
    families = items.select("item_nbr", "family")

    def shares(low: Column, high: Column, out: str) -> DataFrame:
        rows = sales.filter((F.col("date") >= low) & (F.col("date") <= high))
        units = clipped("unit_sales")
        level = F.sum(units) if by_sum else F.avg(units)
        per_item = rows.groupBy("store_nbr", "item_nbr").agg(level.alias("_level")).join(families, "item_nbr", "left")
        per_family = per_item.groupBy("store_nbr", "family").agg(F.sum("_level").alias("_family_level"))
        return per_item.join(per_family, ["store_nbr", "family"]).select(
            "store_nbr",
            "item_nbr",
            "family",
            F.coalesce(F.col("_level") / F.nullif("_family_level", F.lit(0.0)), F.lit(0.0)).alias(out),
        )

    recent = shares(F.date_sub(last_day, days), last_day, "_recent")
    if year_ago_weight > 0:
        past = shares(F.date_sub(last_day, 365 + days), F.date_sub(last_day, 365), "_past")
        past = past.select("store_nbr", "item_nbr", "_past")
        mixed = recent.join(past, ["store_nbr", "item_nbr"], "left")
        share = (1 - year_ago_weight) * F.col("_recent") + year_ago_weight * F.coalesce("_past", "_recent")
    else:
        mixed, share = recent, F.col("_recent")
    bounded = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return mixed.select("store_nbr", "item_nbr", "family", bounded.alias("share"))


def shares_from_forecasts(forecasts: DataFrame, items: DataFrame) -> DataFrame:
    """Share of each item in its family's forecast per store."""
    per_item = (
        forecasts.groupBy("store_nbr", "item_nbr")
        .agg(F.sum("predicted_sales").alias("_units"))
        .join(items.select("item_nbr", "family"), "item_nbr")
    )
    per_family = per_item.groupBy("store_nbr", "family").agg(F.sum("_units").alias("_family_units"))
    return per_item.join(per_family.filter("_family_units > 0"), ["store_nbr", "family"]).select(
        "store_nbr", "item_nbr", "family", (F.col("_units") / F.col("_family_units")).alias("share")
    )


def future_promotions(plan: DataFrame, items: DataFrame) -> DataFrame:
    """Planned promotion flag per (date, store, family)."""
    flag = F.coalesce(F.col("onpromotion").cast("boolean"), F.lit(False))
    return (
        with_item_columns(plan, items, "family")
        .groupBy("date", "store_nbr", "family")
        .agg(F.bool_or(flag).cast("int").alias("onpromotion"))
    )


def promotion_days(future: DataFrame) -> DataFrame:
    return future.groupBy("store_nbr", "family").agg(F.sum("onpromotion").alias("promo_days"))


def business_history(business: DataFrame, transactions: DataFrame) -> DataFrame:
    """Daily business with invoices and gross profit, over all stores given."""
    joined = business.join(transactions.select("date", "store_nbr", "n_invoices"), ["date", "store_nbr"], "left")
    daily = joined.groupBy("date").agg(
        F.coalesce(F.sum("n_invoices"), F.lit(0)).alias("invoices"),
        F.sum("revenue").alias("revenue"),
        F.sum("returns").alias("returns"),
        F.sum("cogs").alias("cogs"),
    )
    return daily.withColumn("gross_profit", F.col("revenue") - F.col("returns") - F.col("cogs"))


def period_key(grain: str) -> Column:
    """Text key of a day, month or quarter."""
    if grain == "day":
        return F.date_format("date", "yyyy-MM-dd")
    if grain == "month":
        return F.date_format("date", "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.date_format("date", "yyyy"), F.lit("-Q"), F.quarter("date").cast("string"))
    raise ValueError(f"unknown grain {grain!r}")


def period_units(history: DataFrame, grain: str) -> DataFrame:
    """Units per period: all, perishable, durable."""
    fresh = F.col("perishable") == 1
    return history.groupBy(period_key(grain).alias("period")).agg(
        F.sum("unit_sales").alias("total"),
        F.sum(F.when(fresh, F.col("unit_sales")).otherwise(0.0)).alias("perishable_units"),
        F.sum(F.when(fresh, 0.0).otherwise(F.col("unit_sales"))).alias("durable_units"),
    )


def period_family_units(history: DataFrame, grain: str) -> DataFrame:
    return history.groupBy(period_key(grain).alias("period"), "family").agg(F.sum("unit_sales").alias("units"))


def period_business(history: DataFrame, grain: str | None = None) -> DataFrame:
    """Business totals per period, or over everything given."""
    keys = [period_key(grain).alias("period")] if grain else []
    sums = history.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("invoices", "revenue", "returns", "cogs")]
    )
    return sums.withColumns(
        {
            "net": F.col("revenue") - F.col("returns"),
            "gross": F.col("revenue") - F.col("returns") - F.col("cogs"),
        }
    )


def latest_months(monthly: DataFrame, months: int, keys: list[str]) -> DataFrame:
    """The newest `months` rows of each key; `monthly` has one row per key and month."""
    over = Window.partitionBy(*keys).orderBy(F.desc("month"))
    return monthly.withColumn("_age", F.row_number().over(over)).filter(F.col("_age") <= months).drop("_age")
