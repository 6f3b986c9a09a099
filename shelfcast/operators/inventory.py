"""Stock, reorder and merchandising questions, answered for every store at once.

Forecasts are always summed per (store, item) before they meet another table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import (
    CRITICAL_LOSS_USD,
    DEFAULT_LEAD_TIME,
    DEMAND_CV,
    HORIZON_DAYS,
    OVERSTOCK_DAYS,
    SERVICE_Z,
    STOCKOUT_UNIT_LOSS_USD,
)
from shelfcast.functions.expr import check_number, check_count, grade, ratio
from shelfcast.functions.ranking import top_k
from shelfcast.operators.aggregates import abc_classes
from shelfcast.operators.enrich import join_prices

PAIR = ["store_nbr", "item_nbr"]


def demand(forecasts: DataFrame) -> DataFrame:
    """Total and mean daily forecast per (store, item), graded so that comparisons with stock
    and rankings do not hang on the last bits of a sum.  Rows that are sums over `n_days` days count as so many."""
    total = F.sum("predicted_sales")
    mean = total / F.sum("n_days") if "n_days" in forecasts.columns else F.avg("predicted_sales")
    return forecasts.groupBy(*PAIR).agg(grade(total).alias("forecast"), grade(mean).alias("daily_demand"))


def position(forecasts: DataFrame, inventory: DataFrame, items: DataFrame) -> DataFrame:
    """Demand next to stock for every managed (store, item), with item attributes."""
    stock = inventory.select(*PAIR, "current_stock", "lead_time_days")
    names = items.select("item_nbr", "name", "family", "perishable")
    return demand(forecasts).join(stock, PAIR).join(names, "item_nbr", "left")


def derive_inventory(forecasts: DataFrame, policy: DataFrame) -> DataFrame:
    """Opening stock from sales speed and a policy of lead time and days to cover.

    Stock is whole units; the small offset keeps exact halves rounding up whatever the
    order the mean was summed in.
    """
    units = F.floor(F.coalesce("daily_demand", F.lit(0.0)) * F.col("coverage_days") + 0.5 + 1e-9)
    return demand(forecasts).join(policy, PAIR).select(
        *PAIR,
        F.greatest(units.cast("double"), F.lit(0.0)).alias("current_stock"),
        "lead_time_days",
        F.lit(None).cast("timestamp").alias("last_updated"),
    )


def default_policy(pairs: DataFrame) -> DataFrame:
    """Policy derived from the keys: six in ten normal cover, two short, two long."""
    store, item = F.col("store_nbr").cast("long"), F.col("item_nbr").cast("long")
    lead = (31 * store + 17 * item) % 7 + 1
    state = (7 * store + 13 * item) % 10
    cover = F.when(state <= 5, lead + 4).when(state <= 7, state - 5).otherwise(30 + (11 * store + 5 * item) % 15)
    return pairs.select(*PAIR).distinct().select(
        *PAIR, lead.cast("int").alias("lead_time_days"), cover.cast("int").alias("coverage_days")
    )


def _short(position_rows: DataFrame) -> DataFrame:
    return position_rows.filter(F.col("forecast") > F.col("current_stock")).withColumn(
        "deficit", F.col("forecast") - F.col("current_stock")
    )


def stockout_risk(position_rows: DataFrame, k: int = 10) -> DataFrame:
    """Items whose horizon demand exceeds stock: the k largest deficits of each store and
    the true number at risk."""
    risky = _short(position_rows)
    counts = risky.groupBy("store_nbr").agg(F.count(F.lit(1)).alias("risk_items"))
    top = top_k(risky, ["store_nbr"], [F.desc("deficit"), F.col("item_nbr")], k)
    return top.join(counts, "store_nbr")


def perishable_risk(position_rows: DataFrame, k: int = 10) -> DataFrame:
    """`stockout_risk` for perishable items, with days of cover."""
    fresh = position_rows.filter(F.col("perishable") == 1)
    return stockout_risk(fresh, k).withColumn(
        "days_of_cover", ratio(F.col("current_stock"), F.col("forecast") / HORIZON_DAYS)
    )


def reorder_point(position_rows: DataFrame, sigma: str | None = None) -> DataFrame:
    """Safety stock and reorder point; demand spread is a fixed share of the mean unless
    `sigma` names a column that holds it."""
    lead = F.col("lead_time_days").cast("double")
    lead = F.when(lead.isNull() | (lead == 0), F.lit(float(DEFAULT_LEAD_TIME))).otherwise(lead)
    daily = F.col("daily_demand")
    spread = F.col(sigma) if sigma else DEMAND_CV * daily
    safety = SERVICE_Z * spread * F.sqrt(lead)
    rop = daily * lead + safety
    return position_rows.withColumns(
        {
            "lead_time_used": lead,
            "safety_stock": safety,
            "reorder_point": rop,
            "need_reorder": F.col("current_stock") <= rop,
        }
    )


def purchase_target(position_rows: DataFrame, safety_days: float | None = None) -> DataFrame:
    """Units to order: horizon demand less stock, or demand over lead time plus safety days."""
    need = F.col("forecast")
    if safety_days is not None:
        lead = F.coalesce(F.col("lead_time_days"), F.lit(DEFAULT_LEAD_TIME))
        need = F.col("daily_demand") * (lead + F.lit(check_number(safety_days, "safety_days")))
    order = F.greatest(F.lit(0.0), need - F.col("current_stock"))
    return position_rows.withColumns({"order_quantity": order, "needs_reorder": order > 0})


def demand_multiplier(position_rows: DataFrame, multiplier: float | Column) -> DataFrame:
    """Demand scaled by a factor (a number, or a column with one factor per row)."""
    factor = multiplier if isinstance(multiplier, Column) else F.lit(check_number(multiplier, "multiplier"))
    scaled = F.col("forecast") * factor
    return position_rows.withColumns(
        {
            "multiplier": factor,
            "new_forecast": scaled,
            "shortfall": F.greatest(F.lit(0.0), scaled - F.col("current_stock")),
            "will_stockout": scaled > F.col("current_stock"),
        }
    )


def stockout_loss(demand_rows: DataFrame, days: float) -> DataFrame:
    """Units and revenue lost when an item is out of stock for `days` days."""
    lost = F.col("daily_demand") * int(check_number(days, "days"))
    revenue = lost * STOCKOUT_UNIT_LOSS_USD
    level = F.when(revenue > CRITICAL_LOSS_USD, "critical").otherwise("moderate")
    return demand_rows.withColumns({"lost_units": lost, "lost_revenue": revenue, "impact_level": level})


def cross_sell(demand_rows: DataFrame, items: DataFrame, wanted: DataFrame | None = None, k: int = 3) -> DataFrame:
    """The k best forecast items of the same family for every (store, item), itself excluded.

    An item can only ever be offered the family's k+1 best, so items meet that short list
    and never each other.
    """
    named = demand_rows.join(items.select("item_nbr", "family"), "item_nbr")
    order = [F.desc("forecast"), F.col("item_nbr")]
    best = top_k(named, ["store_nbr", "family"], order, k + 1, "_place").select(
        "store_nbr",
        "family",
        F.col("item_nbr").alias("suggested_item"),
        F.col("forecast").alias("suggested_forecast"),
        "_place",
    )
    lists = best.groupBy("store_nbr", "family").agg(
        F.array_sort(F.collect_list(F.struct("_place", "suggested_item", "suggested_forecast"))).alias("_best")
    )
    targets = named if wanted is None else named.join(wanted, PAIR, "left_semi")
    others = F.filter("_best", lambda b: b["suggested_item"] != F.col("item_nbr"))
    return (
        targets.join(lists, ["store_nbr", "family"])
        .select("store_nbr", "item_nbr", "family", F.posexplode(F.slice(others, 1, k)).alias("_pos", "_s"))
        .select(
            "store_nbr",
            "item_nbr",
            "family",
            (F.col("_pos") + 1).alias("rank"),
            "_s.suggested_item",
            "_s.suggested_forecast",
        )
    )


def slow_movers(position_rows: DataFrame, k: int = 5) -> DataFrame:
    """Stock above twice the demand: the k largest stocks of a store and the markdown to try."""
    stuck = position_rows.filter(
        (F.col("forecast") < F.col("current_stock") / 2) & (F.col("current_stock") > 20)
    ).withColumn("markdown_pct", F.when(F.col("forecast") > 5, 15).otherwise(30))
    counts = stuck.groupBy("store_nbr").agg(F.count(F.lit(1)).alias("slow_items"))
    return top_k(stuck, ["store_nbr"], [F.desc("current_stock"), F.col("item_nbr")], k).join(counts, "store_nbr")


def reorder_profit(position_rows: DataFrame, prices: DataFrame, k: int = 5) -> DataFrame:
    """Gross profit won by filling each gap, the k best per store and the store total."""
    margin = F.col("unit_price") * (1 - F.col("cost_ratio"))
    gaps = join_prices(_short(position_rows), prices).withColumn("est_profit", F.col("deficit") * margin)
    totals = gaps.groupBy("store_nbr").agg(
        F.count(F.lit(1)).alias("items_to_reorder"), F.sum("est_profit").alias("store_profit")
    )
    best = top_k(gaps, ["store_nbr"], [F.desc("est_profit"), F.col("item_nbr")], check_count(k, "k"))
    return best.join(totals, "store_nbr")


def _valued(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Stock value at cost."""
    priced = join_prices(df, prices)
    return priced.withColumn(
        "stock_value", F.col("current_stock") * F.col("unit_price") * F.col("cost_ratio")
    )


def inventory_health(
    inventory: DataFrame,
    items: DataFrame,
    prices: DataFrame,
    business: DataFrame,
    position_rows: DataFrame,
    months: int = 3,
) -> DataFrame:
    """Stock value, days on hand, yearly turnover and number of overstocked items per store."""
    months = check_count(months, "months")
    families = items.select("item_nbr", "family")
    value = (
        _valued(inventory.join(families, "item_nbr", "left"), prices)
        .groupBy("store_nbr")
        .agg(F.sum("stock_value").alias("stock_value"))
    )
    since = F.add_months(business.agg(F.max("date")).scalar(), -months)
    cost = (
        business.filter(F.col("date") >= since)
        .groupBy("store_nbr")
        .agg(F.sum("cogs").alias("_cogs"), F.count_distinct("date").alias("_days"))
    )
    over = overstock(position_rows).groupBy("store_nbr").agg(F.count(F.lit(1)).alias("overstock_items"))
    joined = value.join(cost, "store_nbr").join(over, "store_nbr", "left")
    daily = F.col("_cogs") / F.col("_days")
    return joined.filter(F.col("_cogs") > 0).select(
        "store_nbr",
        "stock_value",
        daily.alias("daily_cogs"),
        (F.col("stock_value") / daily).alias("days_on_hand"),
        ratio(F.col("_cogs") / months * 12, F.col("stock_value")).alias("turnover_per_year"),
        F.coalesce("overstock_items", F.lit(0)).alias("overstock_items"),
    )


def overstock(position_rows: DataFrame) -> DataFrame:
    """Items whose stock covers more than 30 days of their own demand."""
    held = position_rows.filter((F.col("current_stock") > 0) & (F.col("forecast") > 0))
    cover = ratio(F.col("current_stock"), F.col("forecast") / HORIZON_DAYS)
    return held.withColumn("cover_days", cover).filter(F.col("cover_days") > OVERSTOCK_DAYS)


def top_overstock(position_rows: DataFrame, prices: DataFrame, k: int = 3) -> DataFrame:
    """The k overstocked items of a store that bind the most money."""
    valued = _valued(overstock(position_rows), prices)
    return top_k(valued, ["store_nbr"], [F.desc("stock_value"), F.col("item_nbr")], k)


def never_sold(inventory: DataFrame, sold: DataFrame, items: DataFrame, prices: DataFrame) -> DataFrame:
    """Stock on hand of items never sold in that store, valued at cost."""
    moved = sold.filter(F.col("unit_sales") != 0).select(*PAIR)
    idle = inventory.filter(F.col("current_stock") > 0).join(moved, PAIR, "left_anti")
    return _valued(idle.join(items.select("item_nbr", "family"), "item_nbr"), prices)


def recently_dead(inventory: DataFrame, stats: DataFrame, prices: DataFrame, floor: float = 0.01) -> DataFrame:
    """Stock on hand of items the whole chain has hardly sold lately."""
    quiet = stats.filter(F.coalesce("avg_daily_45d", F.lit(0.0)) < floor).select(
        "item_nbr", "family", "avg_daily_45d"
    )
    return _valued(inventory.filter(F.col("current_stock") > 0).join(quiet, "item_nbr"), prices)


def dead_stock(dead: DataFrame, k: int = 10) -> DataFrame:
    """The k most valuable rows per store, with the store's true count and tied-up value."""
    totals = dead.groupBy("store_nbr").agg(
        F.count(F.lit(1)).alias("dead_items"), F.sum("stock_value").alias("dead_value")
    )
    top = top_k(dead, ["store_nbr"], [F.desc("stock_value"), F.col("item_nbr")], check_count(k, "k"))
    return top.join(totals, "store_nbr")


def store_abc(sold: DataFrame, items: DataFrame, prices: DataFrame) -> DataFrame:
    """ABC class of each sold item inside its store, by sales value."""
    valued = join_prices(
        sold.filter(F.col("unit_sales") > 0).join(items.select("item_nbr", "family"), "item_nbr"), prices
    ).select(*PAIR, "family", (F.col("unit_sales") * F.col("unit_price")).alias("sales_value"))
    return abc_classes(valued, "sales_value", ["store_nbr"])


def abc_summary(classes: DataFrame) -> DataFrame:
    """Items and value share per store and class."""
    return classes.groupBy("store_nbr", "abc_class").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("sales_value").alias("class_value"),
        (F.sum("sales_value") / F.max("total_value") * 100).alias("value_share_pct"),
    )


def abc_top(classes: DataFrame, k: int = 5) -> DataFrame:
    """The k best items of every class and store."""
    ranked = top_k(
        classes, ["store_nbr", "abc_class"], [F.desc("sales_value"), F.col("item_nbr")], check_count(k, "k")
    )
    return ranked.withColumn("cum_share_pct", F.col("cum_value") / F.col("total_value") * 100)


def item_profile(
    items: DataFrame, inventory: DataFrame, forecasts: DataFrame, sold: DataFrame
) -> DataFrame:
    """One row per managed (item, store) with stock and forecast, plus item totals."""
    per_store = inventory.select(*PAIR, "current_stock", "lead_time_days").join(
        demand(forecasts).select(*PAIR, "forecast"), PAIR, "left"
    )
    totals = inventory.groupBy("item_nbr").agg(F.sum("current_stock").alias("total_stock"))
    units = sold.groupBy("item_nbr").agg(F.sum("unit_sales").alias("units_sold"))
    return (
        items.select("item_nbr", "name", "family", "class", "perishable")
        .join(per_store, "item_nbr")
        .join(totals, "item_nbr", "left")
        .join(units, "item_nbr", "left")
        .withColumns(
            {
                "forecast": F.coalesce("forecast", F.lit(0.0)),
                "units_sold": F.coalesce("units_sold", F.lit(0.0)),
            }
        )
    )


def item_profile_nested(profile: DataFrame) -> DataFrame:
    """One row per item with its stores as an array; at most one entry per store."""
    entry = F.struct("store_nbr", "current_stock", "lead_time_days", "forecast")
    return profile.groupBy(
        "item_nbr", "name", "family", "class", "perishable", "total_stock", "units_sold"
    ).agg(F.array_sort(F.collect_list(entry)).alias("per_store"))
