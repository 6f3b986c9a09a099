"""Catalogue pages, forecast views and mix charts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import DEFAULT_FAMILY_RMSLE, HORIZON_DAYS, LOW_STOCK_PER_STORE
from shelfcast.functions.expr import check_count, grade
from shelfcast.functions.ranking import top_k, top_overall
from shelfcast.functions.running import running_total


def matches(search: str) -> Column:
    """Item number, family or name holds the text, in any case; the text is taken literally."""
    needle = F.lower(F.lit(search.strip()))
    fields = [F.col("item_nbr").cast("string"), F.lower("family"), F.lower("name")]
    hits = [F.coalesce(f.contains(needle), F.lit(False)) for f in fields]
    return hits[0] | hits[1] | hits[2]


def search_products(items: DataFrame, search: str) -> DataFrame:
    return items.filter(matches(search))


def stock_status(stock: Column) -> Column:
    return F.when(F.coalesce(stock, F.lit(0.0)) <= 0, "outofstock").otherwise("active")


def forecast_filter(
    forecasts: DataFrame,
    items: DataFrame | None = None,
    store_nbr: int | None = None,
    family: str | None = None,
    low: str | None = None,
    high: str | None = None,
) -> DataFrame:
    """Forecast rows by store, family (needs the catalogue) and day bounds."""
    out = forecasts
    if store_nbr is not None:
        out = out.filter(F.col("store_nbr") == store_nbr)
    if low is not None:
        out = out.filter(F.col("date") >= F.lit(low).cast("date"))
    if high is not None:
        out = out.filter(F.col("date") <= F.lit(high).cast("date"))
    if family is not None:
        wanted = items.filter(F.col("family") == family).select("item_nbr")
        out = out.join(wanted, "item_nbr", "left_semi")
    return out


def catalog(
    items: DataFrame, inventory: DataFrame, sold: DataFrame, stats: DataFrame | None = None
) -> DataFrame:
    """Every item with stock, units sold, status, class and forecast band.

    The band is the forecast times exp of plus and minus the family's log error.
    """
    stock = inventory.groupBy("item_nbr").agg(F.sum("current_stock").alias("_stock"))
    units = sold.groupBy("item_nbr").agg(F.sum("unit_sales").alias("_units"))
    out = (
        items.select("item_nbr", "name", "family", F.col("class").alias("class_code"), "perishable")
        .join(stock, "item_nbr", "left")
        .join(units, "item_nbr", "left")
        .withColumns(
            {
                "stock": F.coalesce("_stock", F.lit(0.0)),
                "sold": F.coalesce("_units", F.lit(0.0)),
                "status": stock_status(F.col("_stock")),
            }
        )
        .drop("_stock", "_units")
    )
    if stats is None:
        return out
    extra = stats.select("item_nbr", "abc_class", "fc_total_16d", "family_rmsle")
    ahead = F.coalesce("fc_total_16d", F.lit(0.0))
    spread = F.coalesce("family_rmsle", F.lit(DEFAULT_FAMILY_RMSLE))
    return out.join(extra, "item_nbr", "left").withColumns(
        {
            "fc_total_16d": ahead,
            "fc_low": ahead * F.exp(-spread),
            "fc_high": ahead * F.exp(spread),
        }
    )


def sort_value(sort: str) -> Column:
    """What a catalogue is ordered by; ties go by item number."""
    return {
        "sold": F.col("sold"),
        "stock": F.col("stock"),
        "name": F.coalesce("name", F.concat(F.lit("#"), F.col("item_nbr").cast("string"))),
        "item": F.col("item_nbr"),
    }[sort]


def catalog_page(
    rows: DataFrame,
    page: int = 1,
    page_size: int = 20,
    search: str | None = None,
    family: str | None = None,
    status: str | None = None,
    sort: str = "sold",
    descending: bool = True,
) -> DataFrame:
    """One page in a stable order; a page past the end is empty.  Costs as much as all pages up to it;
    `page_after` costs one page."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    by = sort_value(sort)
    found = catalog_filter(rows, search, family, status)
    ordered = found.orderBy(by.desc() if descending else by.asc(), F.col("item_nbr").asc())
    return ordered.offset((page - 1) * page_size).limit(page_size)


def page_after(
    rows: DataFrame,
    cursor: tuple | None = None,
    page_size: int = 20,
    search: str | None = None,
    family: str | None = None,
    status: str | None = None,
    sort: str = "sold",
    descending: bool = True,
) -> DataFrame:
    """The page after `cursor`, the (sort value, item number) of the last row seen, or the first one: each
    task keeps its best `page_size` rows, and nothing is sorted as a whole."""
    if page_size < 1:
        raise ValueError("page_size starts at 1")
    by, item = sort_value(sort), F.col("item_nbr")
    found = catalog_filter(rows, search, family, status)
    if cursor is not None:
        value = F.lit(cursor[0])
        beyond = by < value if descending else by > value
        found = found.filter(beyond | ((by == value) & (item > cursor[1])))
    return found.orderBy(by.desc() if descending else by.asc(), item.asc()).limit(page_size)


def page_cursors(rows: DataFrame, page_size: int = 20, sort: str = "sold", descending: bool = True) -> DataFrame:
    """page, value and item_nbr: the cursor of every page but the first, from counts over range partitions.

    With this table kept, any page is a lookup and one `page_after`."""
    by = sort_value(sort)
    keyed = rows.select(by.alias("value"), "item_nbr", F.lit(1).alias("_one"))
    order = [F.col("value").desc() if descending else F.col("value").asc(), F.col("item_nbr").asc()]
    placed = running_total(keyed, [], order, "_one", "_place", "_all")
    last = placed.filter((F.col("_place") % page_size == 0) & (F.col("_place") < F.col("_all")))
    return last.select((F.col("_place") / page_size + 1).cast("long").alias("page"), "value", "item_nbr")


def catalog_filter(
    rows: DataFrame, search: str | None = None, family: str | None = None, status: str | None = None
) -> DataFrame:
    if search:
        rows = rows.filter(matches(search))
    if family:
        rows = rows.filter(F.col("family") == family.strip())
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows


def catalog_counts(rows: DataFrame, page_size: int = 20) -> DataFrame:
    """Total rows and pages of a filtered catalogue."""
    pages = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / page_size))
    return rows.agg(F.count(F.lit(1)).alias("total"), pages.cast("long").alias("total_pages"))


def low_stock_count(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Items whose summed stock is positive but below 30 per store in scope."""
    stores = inventory.agg(F.greatest(F.count_distinct("store_nbr"), F.lit(1))).scalar()
    threshold = stores * LOW_STOCK_PER_STORE
    stock = (
        inventory.join(items.select("item_nbr"), "item_nbr", "left_semi")
        .groupBy("item_nbr")
        .agg(F.sum("current_stock").alias("_stock"))
    )
    low = (F.col("_stock") > 0) & (F.col("_stock") < threshold)
    return stock.agg(F.count_if(low).alias("low_stock_count")).withColumn("low_stock_threshold", threshold)


def top_products(sold: DataFrame, items: DataFrame, stats: DataFrame, k: int = 8) -> DataFrame:
    """Best sellers of the scope with rank, class and share of all units."""
    total = sold.agg(F.sum("unit_sales")).scalar()
    units = sold.groupBy("item_nbr").agg(F.sum("unit_sales").alias("unit_sales"))
    # rank on the narrow table first; names and classes join only the winners
    best = top_overall(units, [F.desc("unit_sales"), F.col("item_nbr")], check_count(k, "k"))
    return (
        best.join(items.select("item_nbr", "name", "family", F.col("class").alias("class_code")), "item_nbr")
        .join(stats.select("item_nbr", "abc_class"), "item_nbr", "left")
        .withColumn("share_pct", F.when(total > 0, F.col("unit_sales") / total * 100.0).otherwise(0.0))
    )


def top_items_per_store(sold: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """The k best selling items of every store."""
    best = top_k(sold, ["store_nbr"], [F.desc("unit_sales"), F.col("item_nbr")], check_count(k, "k"))
    return best.join(items.select("item_nbr", "name", "family", "perishable"), "item_nbr", "left")


def family_mix(sold: DataFrame, items: DataFrame, top: int = 4, other: str = "Other") -> DataFrame:
    """Units per family: the `top` largest by name and the rest as one bucket.

    Families are ranked after the sum, so the ranking sees one row per family.
    """
    by_family = (
        sold.join(items.select("item_nbr", "family"), "item_nbr")
        .groupBy("family")
        .agg(F.sum("unit_sales").alias("_units"))
    )
    leaders = top_overall(by_family, [F.desc("_units"), F.col("family")], check_count(top, "top"), "_rank")
    named = by_family.join(leaders.select("family", "_rank"), "family", "left")
    label = F.when(F.col("_rank").isNotNull(), F.col("family")).otherwise(F.lit(other))
    buckets = named.groupBy(label.alias("name"), F.coalesce("_rank", F.lit(top + 1)).alias("position")).agg(
        F.sum("_units").alias("units")
    )
    return buckets.filter((F.col("position") <= top) | (F.col("units") > 0))


def first_days(family_forecast: DataFrame, days: int) -> DataFrame:
    """Rows of the first `days` calendar days of the forecast."""
    start = family_forecast.agg(F.min("date")).scalar()
    return family_forecast.filter(F.col("date") < F.date_add(start, days))


def family_trend(family_forecast: DataFrame, days: int = HORIZON_DAYS, top: int = 6) -> DataFrame:
    """Daily forecast of the largest families, long form (date, family, units)."""
    window = first_days(family_forecast, check_count(days, "days"))
    totals = window.groupBy("family").agg(grade(F.sum("predicted_sales")).alias("_total"))
    leaders = top_overall(totals, [F.desc("_total"), F.col("family")], check_count(top, "top"), "family_rank")
    return (
        window.groupBy("date", "family")
        .agg(F.sum("predicted_sales").alias("predicted_sales"))
        .join(leaders.select("family", "family_rank"), "family")
    )


def family_trend_wide(trend: DataFrame, families: list[str]) -> DataFrame:
    """One row per date, one column per family; the caller names the families (at most ten),
    so the pivot needs no pass over the data to find them."""
    return trend.groupBy("date").pivot("family", families).agg(F.sum("predicted_sales"))


def kpi(forecasts: DataFrame) -> DataFrame:
    """Forecast total, number of days and mean per day."""
    total, days = F.sum("predicted_sales"), F.count_distinct("date")
    return forecasts.agg(
        F.coalesce(total, F.lit(0.0)).alias("total_forecast"),
        days.alias("days"),
        F.coalesce(total / F.nullif(days, F.lit(0)), F.lit(0.0)).alias("avg_per_day"),
    )


def daily_forecast(forecasts: DataFrame, max_days: int | None = None) -> DataFrame:
    """Forecast per day in date order, optionally only the first days."""
    daily = forecasts.groupBy("date").agg(F.sum("predicted_sales").alias("predicted_sales")).orderBy("date")
    return daily if max_days is None else daily.limit(max_days)


def forecast_window(forecasts: DataFrame, as_of: date | Column) -> DataFrame:
    """First and last forecast day, age against `as_of`, stale when the last day has passed."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    bounds = forecasts.agg(F.min("date").alias("date_from"), F.max("date").alias("date_to"))
    return bounds.withColumn("days_behind", F.greatest(F.datediff(day, "date_to"), F.lit(0))).withColumn(
        "is_stale", F.col("days_behind") > 0
    )


def forecast_stores(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("store_nbr").distinct()


def product_families(items: DataFrame) -> DataFrame:
    return items.select("family").filter(F.col("family").isNotNull()).distinct()


def sales_summary(forecasts: DataFrame, items: DataFrame, days: int = 7, k: int = 3) -> DataFrame:
    """Per store: forecast of the first `days` days, items in it, real window, top items."""
    window = first_days(forecasts, days)
    per_item = window.groupBy("store_nbr", "item_nbr").agg(
        grade(F.sum("predicted_sales")).alias("item_forecast"),
        F.min("date").alias("_from"),
        F.max("date").alias("_to"),
    )
    totals = per_item.groupBy("store_nbr").agg(
        F.sum("item_forecast").alias("total_forecast"),
        F.count(F.lit(1)).alias("distinct_items"),
        F.min("_from").alias("window_from"),
        F.max("_to").alias("window_to"),
    )
    best = top_k(per_item, ["store_nbr"], [F.desc("item_forecast"), F.col("item_nbr")], k)
    names = items.select("item_nbr", "name", "family")
    return best.drop("_from", "_to").join(totals, "store_nbr").join(names, "item_nbr", "left")


def family_forecast_days(family_forecast: DataFrame, days: int = 7, family: str | None = None) -> DataFrame:
    """Daily forecast of each (store, family) over its own first `days` forecast days.

    `family` matches in any case; see `known_families` for the valid names.
    """
    rows = family_forecast
    if family is not None:
        rows = rows.filter(F.upper("family") == family.strip().upper())
    daily = rows.groupBy("store_nbr", "family", "date").agg(F.sum("predicted_sales").alias("predicted_sales"))
    dates = daily.select("store_nbr", "family", "date").distinct()
    wanted = top_k(dates, ["store_nbr", "family"], [F.col("date")], check_count(days, "days"), "day_index")
    kept = daily.join(wanted, ["store_nbr", "family", "date"])
    totals = kept.groupBy("store_nbr", "family").agg(F.sum("predicted_sales").alias("total_forecast"))
    return kept.join(totals, ["store_nbr", "family"])


def known_families(family_forecast: DataFrame, store_nbr: int) -> DataFrame:
    return family_forecast.filter(F.col("store_nbr") == store_nbr).select("family").distinct().orderBy("family")
