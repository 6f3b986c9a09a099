"""Stock, reorder and merchandising questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import dashboards, inventory
from shelfcast.plans.registry import d, query, r
from shelfcast.plans.serving import RetailTables

PAIR = ["store_nbr", "item_nbr"]


@query(
    "derived_inventory",
    "D1",
    f"SELECT store_nbr, item_nbr, {r('current_stock')} AS current_stock, lead_time_days FROM v_inventory",
)
def derived_inventory(t: RetailTables):
    return t.inventory.drop("last_updated")


@query(
    "stock_position",
    "J4",
    f"""
    SELECT store_nbr, item_nbr, {r("forecast")} AS forecast, {r("daily_demand")} AS daily_demand,
           {r("current_stock")} AS current_stock, lead_time_days, name, family, perishable FROM v_position
    """,
)
def stock_position(t: RetailTables):
    return inventory.position(t.forecast_totals, t.inventory, t.items)


def _risk_sql(condition: str, extra: str, k: int) -> str:
    return f"""
    WITH s AS (SELECT *, forecast - current_stock AS deficit FROM v_position
               WHERE forecast > current_stock AND {condition}),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY deficit DESC, item_nbr) AS rank,
                 count(*) OVER (PARTITION BY store_nbr) AS risk_items FROM s)
    SELECT store_nbr, item_nbr, name, family, {r("forecast")} AS forecast, {r("current_stock")} AS current_stock,
           lead_time_days, {r("deficit")} AS deficit, {extra} CAST(rank AS INTEGER) AS rank, risk_items
    FROM k WHERE rank <= {k}
    """


@query("stockout_risk", "B2 K7", _risk_sql("TRUE", "", 10))
def stockout_risk(t: RetailTables):
    return inventory.stockout_risk(t.position).drop("daily_demand", "perishable")


@query(
    "perishable_risk",
    "B19",
    _risk_sql("perishable = 1", f"{r('current_stock / (forecast / 16)')} AS days_of_cover,", 10),
)
def perishable_risk(t: RetailTables):
    return inventory.perishable_risk(t.position).drop("daily_demand", "perishable")


@query(
    "reorder_point",
    "B3",
    f"""
    WITH s AS (SELECT *, CASE WHEN coalesce(lead_time_days, 0) = 0 THEN 3.0 ELSE lead_time_days END AS lt FROM v_position),
    p AS (SELECT *, CAST(1.65 AS DOUBLE) * (CAST(0.2 AS DOUBLE) * daily_demand) * sqrt(lt) AS ss FROM s)
    SELECT store_nbr, item_nbr, name, family, {r("current_stock")} AS current_stock,
           {r("daily_demand")} AS daily_demand, {r("lt")} AS lead_time_used, {r("ss")} AS safety_stock,
           {r("daily_demand * lt + ss")} AS reorder_point,
           current_stock <= daily_demand * lt + ss AS need_reorder
    FROM p
    """,
)
def reorder_point(t: RetailTables):
    return inventory.reorder_point(t.position).drop("forecast", "lead_time_days", "perishable")


@query(
    "purchase_target",
    "B4",
    f"""
    SELECT store_nbr, item_nbr, {r("forecast")} AS forecast, {r("current_stock")} AS current_stock,
           {r("greatest(0, forecast - current_stock)")} AS order_quantity, forecast > current_stock AS needs_reorder,
           {r("greatest(0, daily_demand * (lead_time_days + 2) - current_stock)")} AS order_for_lead_time
    FROM v_position
    """,
)
def purchase_target(t: RetailTables):
    plain = inventory.purchase_target(t.position)
    cover = inventory.purchase_target(t.position, safety_days=2).select(
        *PAIR, F.col("order_quantity").alias("order_for_lead_time")
    )
    return plain.select(*PAIR, "forecast", "current_stock", "order_quantity", "needs_reorder").join(cover, PAIR)


@query(
    "demand_multiplier",
    "B5",
    f"""
    WITH s AS (SELECT *, CASE WHEN perishable = 1 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS m FROM v_position)
    SELECT store_nbr, item_nbr, {r("m")} AS multiplier, {r("forecast")} AS forecast,
           {r("forecast * m")} AS new_forecast, {r("current_stock")} AS current_stock,
           {r("greatest(0, forecast * m - current_stock)")} AS shortfall, forecast * m > current_stock AS will_stockout
    FROM s
    """,
)
def demand_multiplier(t: RetailTables):
    """Perishables half up, all others a fifth down."""
    factor = F.when(F.col("perishable") == 1, 1.5).otherwise(0.8)
    return inventory.demand_multiplier(t.position, factor).select(
        *PAIR, "multiplier", "forecast", "new_forecast", "current_stock", "shortfall", "will_stockout"
    )


@query(
    "stockout_loss",
    "B6",
    f"""
    SELECT store_nbr, item_nbr, {r("daily_demand")} AS daily_demand, {r("daily_demand * 7")} AS lost_units,
           {r("daily_demand * 7 * 5")} AS lost_revenue,
           CASE WHEN daily_demand * 7 * 5 > 100 THEN 'critical' ELSE 'moderate' END AS impact_level
    FROM v_demand
    """,
)
def stockout_loss(t: RetailTables):
    return inventory.stockout_loss(inventory.demand(t.forecast_totals), 7).drop("forecast")


@query(
    "cross_sell",
    "B8",
    f"""
    WITH n AS (SELECT d.*, family FROM v_demand d JOIN v_items USING (item_nbr)),
    k AS (SELECT a.store_nbr, a.item_nbr, a.family, b.item_nbr AS suggested_item, b.forecast AS f,
                 row_number() OVER (PARTITION BY a.store_nbr, a.item_nbr ORDER BY b.forecast DESC, b.item_nbr) AS rank
          FROM n a JOIN n b ON a.store_nbr = b.store_nbr AND a.family = b.family AND a.item_nbr <> b.item_nbr)
    SELECT store_nbr, item_nbr, family, CAST(rank AS INTEGER) AS rank, suggested_item, {r("f")} AS suggested_forecast
    FROM k WHERE rank <= 3
    """,
)
def cross_sell(t: RetailTables):
    return inventory.cross_sell(inventory.demand(t.forecast_totals), t.items)


@query(
    "slow_movers",
    "B9",
    f"""
    WITH s AS (SELECT * FROM v_position WHERE forecast < current_stock / 2 AND current_stock > 20),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY current_stock DESC, item_nbr) AS rank,
                 count(*) OVER (PARTITION BY store_nbr) AS slow_items FROM s)
    SELECT store_nbr, item_nbr, name, family, {r("forecast")} AS forecast, {r("current_stock")} AS current_stock,
           CASE WHEN forecast > 5 THEN 15 ELSE 30 END AS markdown_pct, CAST(rank AS INTEGER) AS rank, slow_items
    FROM k WHERE rank <= 5
    """,
)
def slow_movers(t: RetailTables):
    return inventory.slow_movers(t.position).drop("daily_demand", "lead_time_days", "perishable")


@query(
    "reorder_profit",
    "B23",
    f"""
    WITH s AS (SELECT *, forecast - current_stock AS deficit FROM v_position WHERE forecast > current_stock),
    p AS (SELECT s.*, deficit * (unit_price * (1 - cost_ratio)) AS est_profit
          FROM s JOIN v_item_prices q ON q.family = s.family),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY est_profit DESC, item_nbr) AS rank,
                 count(*) OVER (PARTITION BY store_nbr) AS items_to_reorder,
                 sum(est_profit) OVER (PARTITION BY store_nbr) AS store_profit FROM p)
    SELECT store_nbr, item_nbr, family, {r("deficit")} AS deficit, {r("est_profit")} AS est_profit,
           CAST(rank AS INTEGER) AS rank, items_to_reorder, {r("store_profit")} AS store_profit
    FROM k WHERE rank <= 5
    """,
)
def reorder_profit(t: RetailTables):
    return inventory.reorder_profit(t.position, t.prices).select(
        *PAIR, "family", "deficit", "est_profit", "rank", "items_to_reorder", "store_profit"
    )


@query(
    "inventory_health",
    "B24",
    f"""
    WITH v AS (SELECT store_nbr, sum(current_stock * unit_price * cost_ratio) AS stock_value
               FROM v_inventory JOIN v_items i USING (item_nbr) JOIN v_item_prices p ON p.family = i.family GROUP BY 1),
    c AS (SELECT store_nbr, sum(cogs) AS cogs, count(DISTINCT date) AS days FROM v_business
          WHERE date >= (SELECT max(date) FROM v_business) - INTERVAL 3 MONTH GROUP BY 1),
    o AS (SELECT store_nbr, count(*) AS n FROM v_position
          WHERE current_stock > 0 AND forecast > 0 AND current_stock / (forecast / 16) > 30 GROUP BY 1)
    SELECT store_nbr, {r("stock_value")} AS stock_value, {r("cogs / days")} AS daily_cogs,
           {r("stock_value / (cogs / days)")} AS days_on_hand,
           {r("CASE WHEN stock_value > 0 THEN cogs / 3 * 12 / stock_value END")} AS turnover_per_year,
           coalesce(n, 0) AS overstock_items
    FROM v JOIN c USING (store_nbr) LEFT JOIN o USING (store_nbr) WHERE cogs > 0
    """,
)
def inventory_health(t: RetailTables):
    return inventory.inventory_health(t.inventory, t.items, t.prices, t.business, t.position)


@query(
    "top_overstock",
    "B24",
    f"""
    WITH o AS (SELECT s.*, current_stock / (forecast / 16) AS cover_days,
                      current_stock * unit_price * cost_ratio AS stock_value
               FROM v_position s JOIN v_item_prices p ON p.family = s.family
               WHERE current_stock > 0 AND forecast > 0 AND current_stock / (forecast / 16) > 30),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY stock_value DESC, item_nbr) AS rank FROM o)
    SELECT store_nbr, item_nbr, {r("cover_days")} AS cover_days, {r("stock_value")} AS stock_value,
           CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3
    """,
)
def top_overstock(t: RetailTables):
    return inventory.top_overstock(t.position, t.prices).select(*PAIR, "cover_days", "stock_value", "rank")


def _dead_sql(source: str) -> str:
    return f"""
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY stock_value DESC, item_nbr) AS rank,
                 count(*) OVER (PARTITION BY store_nbr) AS dead_items,
                 sum(stock_value) OVER (PARTITION BY store_nbr) AS dead_value FROM {source})
    SELECT store_nbr, item_nbr, family, {r("current_stock")} AS current_stock, {r("stock_value")} AS stock_value,
           CAST(rank AS INTEGER) AS rank, dead_items, {r("dead_value")} AS dead_value FROM k WHERE rank <= 10
    """


DEAD_COLUMNS = [*PAIR, "family", "current_stock", "stock_value", "rank", "dead_items", "dead_value"]


@query(
    "never_sold_stock",
    "B25 J6",
    f"""
    WITH stock AS (SELECT store_nbr, item_nbr, current_stock FROM v_inventory
                   UNION ALL SELECT (store_nbr + 1) % 25, item_nbr, lead_time_days FROM v_inventory),
    x AS (SELECT store_nbr, item_nbr, sum(current_stock) AS current_stock FROM stock GROUP BY ALL),
    dead AS (SELECT x.*, i.family, current_stock * unit_price * cost_ratio AS stock_value
             FROM x JOIN v_items i USING (item_nbr) JOIN v_item_prices p ON p.family = i.family
             LEFT JOIN v_sold s ON s.store_nbr = x.store_nbr AND s.item_nbr = x.item_nbr
             WHERE current_stock > 0 AND coalesce(s.unit_sales, 0) = 0),
    {_dead_sql("dead")}
    """,
)
def never_sold_stock(t: RetailTables):
    """Stock as counted plus goods sent by mistake to the next store, which may never have
    sold them."""
    strays = t.inventory.select(
        ((F.col("store_nbr") + 1) % 25).alias("store_nbr"),
        "item_nbr",
        F.col("lead_time_days").cast("double").alias("current_stock"),
    )
    counted = t.inventory.select(*PAIR, "current_stock").unionByName(strays)
    stock = counted.groupBy(*PAIR).agg(F.sum("current_stock").alias("current_stock"))
    dead = inventory.never_sold(stock, t.sold, t.items, t.prices)
    return inventory.dead_stock(dead).select(*DEAD_COLUMNS)


@query(
    "recently_dead_stock",
    "B25",
    f"""
    WITH dead AS (SELECT v.store_nbr, v.item_nbr, v.current_stock, s.family,
                         current_stock * unit_price * cost_ratio AS stock_value
                  FROM v_inventory v JOIN v_sku s USING (item_nbr) JOIN v_item_prices p ON p.family = s.family
                  WHERE current_stock > 0 AND avg_daily_45d < 0.1),
    {_dead_sql("dead")}
    """,
)
def recently_dead_stock(t: RetailTables):
    dead = inventory.recently_dead(t.inventory, t.sku_stats, t.prices, floor=0.1)
    return inventory.dead_stock(dead).select(*DEAD_COLUMNS)


ABC_SQL = """
    v AS (SELECT store_nbr, item_nbr, i.family, unit_sales * unit_price AS value
          FROM v_sold JOIN v_items i USING (item_nbr) JOIN v_item_prices p ON p.family = i.family WHERE unit_sales > 0),
    c AS (SELECT *, sum(value) OVER (PARTITION BY store_nbr) AS total,
                 sum(value) OVER (PARTITION BY store_nbr ORDER BY value DESC, item_nbr ROWS UNBOUNDED PRECEDING) AS cum
          FROM v),
    a AS (SELECT *, CASE WHEN cum <= CAST(0.80 AS DOUBLE) * total THEN 'A'
                         WHEN cum <= CAST(0.95 AS DOUBLE) * total THEN 'B' ELSE 'C' END AS abc_class FROM c)
"""


@query(
    "store_abc_summary",
    "B26 W16",
    f"""
    WITH {ABC_SQL}
    SELECT store_nbr, abc_class, count(*) AS item_count, {r("sum(value)")} AS class_value,
           {r("sum(value) / max(total) * 100")} AS value_share_pct
    FROM a GROUP BY ALL
    """,
)
def store_abc_summary(t: RetailTables):
    return inventory.abc_summary(inventory.store_abc(t.sold, t.items, t.prices))


@query(
    "store_abc_top",
    "B26",
    f"""
    WITH {ABC_SQL},
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr, abc_class ORDER BY value DESC, item_nbr) AS rank FROM a)
    SELECT store_nbr, abc_class, item_nbr, family, {r("value")} AS sales_value,
           {r("cum / total * 100")} AS cum_share_pct, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5
    """,
)
def store_abc_top(t: RetailTables):
    top = inventory.abc_top(inventory.store_abc(t.sold, t.items, t.prices))
    return top.drop("cum_value", "total_value")


PROFILE_SQL = f"""
    SELECT i.item_nbr, i.name, i.family, i.class, i.perishable, v.store_nbr, {r("v.current_stock")} AS current_stock,
           v.lead_time_days, {r("coalesce(d.forecast, 0)")} AS forecast,
           {r("sum(v.current_stock) OVER (PARTITION BY i.item_nbr)")} AS total_stock,
           {r("coalesce(s.units, 0)")} AS units_sold
    FROM v_inventory v JOIN v_items i USING (item_nbr)
    LEFT JOIN v_demand d ON d.store_nbr = v.store_nbr AND d.item_nbr = v.item_nbr
    LEFT JOIN (SELECT item_nbr, sum(unit_sales) AS units FROM v_sold GROUP BY 1) s ON s.item_nbr = v.item_nbr
"""


@query("item_profile", "B15", PROFILE_SQL)
def item_profile(t: RetailTables):
    return inventory.item_profile(t.items, t.inventory, t.forecast_totals, t.sold)


@query(
    "item_profile_nested",
    "B15",
    f"""
    WITH p AS ({PROFILE_SQL})
    SELECT item_nbr, name, {r("any_value(total_stock)")} AS total_stock, count(*) AS stores,
           string_agg(CAST(store_nbr AS VARCHAR), ',' ORDER BY store_nbr) AS store_list
    FROM p GROUP BY item_nbr, name
    """,
)
def item_profile_nested(t: RetailTables):
    nested = inventory.item_profile_nested(inventory.item_profile(t.items, t.inventory, t.forecast_totals, t.sold))
    stores = F.transform("per_store", lambda s: s["store_nbr"].cast("string"))
    return nested.select(
        "item_nbr",
        "name",
        "total_stock",
        F.size("per_store").cast("long").alias("stores"),
        F.array_join(stores, ",").alias("store_list"),
    )


CATALOG_SQL = f"""
    c AS (SELECT i.item_nbr, i.name, i.family, i.class AS class_code, i.perishable,
                 coalesce(v.stock, 0) AS stock, coalesce(s.units, 0) AS sold,
                 CASE WHEN coalesce(v.stock, 0) <= 0 THEN 'outofstock' ELSE 'active' END AS status,
                 k.abc_class, k.fc_total_16d, k.family_rmsle,
                 k.fc_total_16d * exp(-k.family_rmsle) AS fc_low, k.fc_total_16d * exp(k.family_rmsle) AS fc_high
          FROM v_items i
          LEFT JOIN (SELECT item_nbr, sum(current_stock) AS stock FROM v_inventory GROUP BY 1) v USING (item_nbr)
          LEFT JOIN (SELECT item_nbr, sum(unit_sales) AS units FROM v_sold GROUP BY 1) s USING (item_nbr)
          LEFT JOIN v_sku k USING (item_nbr))
"""
CATALOG_OUT = f"""
    item_nbr, name, family, class_code, perishable, {r("stock")} AS stock, {r("sold")} AS sold, status, abc_class,
    {r("fc_total_16d")} AS fc_total_16d, {r("family_rmsle")} AS family_rmsle, {r("fc_low")} AS fc_low,
    {r("fc_high")} AS fc_high
"""


def _catalog(t: RetailTables):
    return dashboards.catalog(t.items, t.inventory, t.sold, t.sku_stats)


@query("product_catalog", "K1 P19", f"WITH {CATALOG_SQL} SELECT {CATALOG_OUT} FROM c")
def product_catalog(t: RetailTables):
    return _catalog(t)


@query(
    "product_catalog_page",
    "K1 P17",
    f"""
    WITH {CATALOG_SQL}
    SELECT {CATALOG_OUT} FROM (
        SELECT * FROM c WHERE (CAST(item_nbr AS VARCHAR) LIKE '%ri%' OR lower(family) LIKE '%ri%' OR lower(name) LIKE '%ri%')
                          AND status = 'active'
        ORDER BY stock DESC, item_nbr LIMIT 20 OFFSET 20)
    """,
)
def product_catalog_page(t: RetailTables):
    return dashboards.catalog_page(_catalog(t), page=2, page_size=20, search=" RI ", status="active", sort="stock")


@query(
    "product_catalog_cursor",
    "K1",
    f"WITH {CATALOG_SQL} SELECT {CATALOG_OUT} FROM (SELECT * FROM c ORDER BY stock DESC, item_nbr LIMIT 25 OFFSET 1000)",
)
def product_catalog_cursor(t: RetailTables):
    """Page 41 of 25 by its cursor, which was counted once for all pages."""
    cursors = t.stored("catalog_cursors_stock_25", lambda: dashboards.page_cursors(_catalog(t), 25, "stock"))
    at = cursors.filter("page = 41").first()  # one row
    rows = _catalog(t)
    return dashboards.page_after(rows, (at["value"], at["item_nbr"]), 25, sort="stock") if at else rows.limit(0)


@query(
    "product_search",
    "P17",
    """
    SELECT item_nbr, name, family FROM v_items
    WHERE CAST(item_nbr AS VARCHAR) LIKE '%mall%' OR lower(family) LIKE '%mall%' OR lower(name) LIKE '%mall%'
    """,
)
def product_search(t: RetailTables):
    return dashboards.search_products(t.items, "Mall").select("item_nbr", "name", "family")


@query(
    "product_counts",
    "K1",
    f"""
    WITH {CATALOG_SQL}
    SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS total_pages FROM c
    WHERE status = 'active'
    """,
)
def product_counts(t: RetailTables):
    return dashboards.catalog_counts(dashboards.catalog_filter(_catalog(t), status="active"))


@query(
    "low_stock_count",
    "K2",
    """
    WITH n AS (SELECT greatest(1, count(DISTINCT store_nbr)) * 30 AS threshold FROM v_inventory),
    s AS (SELECT item_nbr, sum(current_stock) AS stock FROM v_inventory GROUP BY 1)
    SELECT count(*) FILTER (stock > 0 AND stock < threshold) AS low_stock_count,
           any_value(threshold) AS low_stock_threshold FROM s, n
    """,
)
def low_stock_count(t: RetailTables):
    return dashboards.low_stock_count(t.items, t.inventory)


@query(
    "stock_status",
    "P19",
    """
    SELECT store_nbr, CASE WHEN current_stock <= 0 THEN 'outofstock' ELSE 'active' END AS status, count(*) AS n_items
    FROM v_inventory GROUP BY ALL
    """,
)
def stock_status(t: RetailTables):
    status = dashboards.stock_status(F.col("current_stock")).alias("status")
    return t.inventory.groupBy("store_nbr", status).agg(F.count(F.lit(1)).alias("n_items"))


@query(
    "top_products",
    "K3",
    f"""
    WITH u AS (SELECT item_nbr, sum(unit_sales) AS units FROM v_sold GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY units DESC, item_nbr) AS rank, sum(units) OVER () AS total FROM u)
    SELECT CAST(rank AS INTEGER) AS rank, item_nbr, i.name, i.family, i.class AS class_code, s.abc_class,
           {r("units")} AS unit_sales, {r("units / total * 100")} AS share_pct
    FROM k JOIN v_items i USING (item_nbr) LEFT JOIN v_sku s USING (item_nbr) WHERE rank <= 8
    """,
)
def top_products(t: RetailTables):
    return dashboards.top_products(t.sold, t.items, t.sku_stats)


@query(
    "top_items_per_store",
    "K4 B13 K7",
    f"""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY unit_sales DESC, item_nbr) AS rank FROM v_sold)
    SELECT store_nbr, item_nbr, name, family, perishable, {r("unit_sales")} AS unit_sales, CAST(rank AS INTEGER) AS rank
    FROM k JOIN v_items USING (item_nbr) WHERE rank <= 5
    """,
)
def top_items_per_store(t: RetailTables):
    return dashboards.top_items_per_store(t.sold, t.items)


@query(
    "family_mix",
    "K5",
    f"""
    WITH u AS (SELECT family, sum(unit_sales) AS units FROM v_sold JOIN v_items USING (item_nbr) GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY units DESC, family) AS rank FROM u)
    SELECT name, position, {r("sum(units)")} AS units
    FROM (SELECT CASE WHEN rank <= 4 THEN family ELSE 'Other' END AS name,
                 CAST(least(rank, 5) AS INTEGER) AS position, units FROM k)
    GROUP BY name, position HAVING position <= 4 OR sum(units) > 0
    """,
)
def family_mix(t: RetailTables):
    return dashboards.family_mix(t.sold, t.items)


TREND_SQL = """
    w AS (SELECT * FROM v_family_forecast WHERE date < (SELECT min(date) FROM v_family_forecast) + 10),
    l AS (SELECT family, row_number() OVER (ORDER BY f DESC, family) AS family_rank
          FROM (SELECT family, floor(sum(predicted_sales) * 1e6 + 0.50003) / 1e6 AS f FROM w GROUP BY family))
"""


@query(
    "family_trend",
    "K6",
    f"""
    WITH {TREND_SQL}
    SELECT {d("date")} AS date, family, {r("sum(predicted_sales)")} AS predicted_sales,
           CAST(any_value(family_rank) AS INTEGER) AS family_rank
    FROM w JOIN l USING (family) WHERE family_rank <= 3 GROUP BY date, family
    """,
)
def family_trend(t: RetailTables):
    return dashboards.family_trend(t.family_forecast, days=10, top=3)


@query(
    "family_trend_wide",
    "K6",
    f"""
    WITH {TREND_SQL}
    SELECT {d("date")} AS date, {r("sum(predicted_sales) FILTER (family = 'PROMO')")} AS "PROMO",
           {r("sum(predicted_sales) FILTER (family = 'SMALL')")} AS "SMALL"
    FROM w GROUP BY date
    """,
)
def family_trend_wide(t: RetailTables):
    trend = dashboards.family_trend(t.family_forecast, days=10, top=10)
    return dashboards.family_trend_wide(trend, ["PROMO", "SMALL"])


@query(
    "kpi",
    "A11",
    f"""
    SELECT {r("sum(predicted_sales)")} AS total_forecast, count(DISTINCT date) AS days,
           {r("sum(predicted_sales) / count(DISTINCT date)")} AS avg_per_day FROM v_forecasts
    """,
)
def kpi(t: RetailTables):
    return dashboards.kpi(t.forecast_days)


@query(
    "daily_forecast",
    "A12 P18",
    f"""
    SELECT {d("date")} AS date, {r("sum(predicted_sales)")} AS predicted_sales
    FROM v_forecasts JOIN v_items USING (item_nbr), v_origin
    WHERE store_nbr = 3 AND family = 'SMALL' AND date >= DATE '2001-10-21' GROUP BY date
    """,
)
def daily_forecast(t: RetailTables):
    rows = dashboards.forecast_filter(t.forecasts, t.items, store_nbr=3, family="SMALL", low="2001-10-21")
    return dashboards.daily_forecast(rows, 16)


@query(
    "forecast_window",
    "A13",
    f"""
    SELECT {d("min(date)")} AS date_from, {d("max(date)")} AS date_to,
           CAST(greatest(DATE '2001-11-10' - max(date), 0) AS INTEGER) AS days_behind,
           greatest(DATE '2001-11-10' - max(date), 0) > 0 AS is_stale FROM v_forecasts
    """,
)
def forecast_window(t: RetailTables):
    return dashboards.forecast_window(t.forecast_days, F.lit("2001-11-10").cast("date"))


@query("forecast_stores", "A14", "SELECT DISTINCT store_nbr FROM v_forecasts")
def forecast_stores(t: RetailTables):
    return dashboards.forecast_stores(t.forecast_days)


@query("product_families", "A14", "SELECT DISTINCT family FROM v_items")
def product_families(t: RetailTables):
    return dashboards.product_families(t.items)


@query(
    "sales_summary",
    "B1",
    f"""
    WITH i AS (SELECT store_nbr, item_nbr, {r("sum(predicted_sales)")} AS f, min(date) AS lo, max(date) AS hi
               FROM v_forecasts WHERE date < (SELECT min(date) FROM v_forecasts) + 7 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY f DESC, item_nbr) AS rank,
                 sum(f) OVER w AS total, count(*) OVER w AS n, min(lo) OVER w AS wlo, max(hi) OVER w AS whi
          FROM i WINDOW w AS (PARTITION BY store_nbr))
    SELECT store_nbr, item_nbr, name, family, {r("f")} AS item_forecast, CAST(rank AS INTEGER) AS rank,
           {r("total")} AS total_forecast, n AS distinct_items, {d("wlo")} AS window_from, {d("whi")} AS window_to
    FROM k JOIN v_items USING (item_nbr) WHERE rank <= 3
    """,
)
def sales_summary(t: RetailTables):
    return dashboards.sales_summary(t.forecasts, t.items)


@query(
    "family_forecast_days",
    "B14 J8",
    f"""
    WITH s AS (SELECT store_nbr, family, date, sum(predicted_sales) AS p FROM v_family_forecast GROUP BY ALL),
    u AS (SELECT *, dense_rank() OVER (PARTITION BY store_nbr, family ORDER BY date) AS day_index FROM s)
    SELECT store_nbr, family, {d("date")} AS date, {r("p")} AS predicted_sales, CAST(day_index AS INTEGER) AS day_index,
           {r("sum(p) OVER (PARTITION BY store_nbr, family)")} AS total_forecast
    FROM u WHERE day_index <= 7
    """,
)
def family_forecast_days(t: RetailTables):
    return dashboards.family_forecast_days(t.family_forecast, 7)


@query(
    "family_forecast_known",
    "B14",
    "SELECT DISTINCT family FROM v_family_forecast WHERE store_nbr = 3",
)
def family_forecast_known(t: RetailTables):
    return dashboards.known_families(t.family_forecast, 3)
