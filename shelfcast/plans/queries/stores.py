"""Finance, traffic and store questions, and row-level access."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import business, scope
from shelfcast.plans.registry import d, query, r
from shelfcast.plans.serving import RetailTables

MONTHLY = """
    m AS (SELECT store_nbr, strftime(date, '%Y-%m') AS month, sum(revenue) AS revenue, sum(returns) AS returns,
                 sum(cogs) AS cogs, sum(revenue) - sum(returns) - sum(cogs) AS gross_profit
          FROM v_business GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY month DESC) AS age FROM m)
"""


@query(
    "monthly_revenue",
    "B11 A4 J5 W18",
    f"""
    WITH {MONTHLY},
    b AS (SELECT store_nbr, min(date) AS lo, max(date) AS hi FROM v_business GROUP BY 1)
    SELECT k.store_nbr, month, {r("revenue")} AS revenue, {r("returns")} AS returns, {r("cogs")} AS cogs,
           {r("gross_profit")} AS gross_profit, {d("lo")} AS data_from, {d("hi")} AS data_to
    FROM k JOIN b USING (store_nbr) WHERE age <= 12
    """,
)
def monthly_revenue(t: RetailTables):
    return business.monthly_revenue(t.business, 12)


def _store_pairs(t: RetailTables):
    """Each store next to the following one of its type (five numbers on)."""
    keys = t.stores.select("store_nbr")
    pairs = keys.select(
        F.col("store_nbr").alias("store_1"), ((F.col("store_nbr") + 5) % 25).cast("int").alias("store_2")
    )
    return pairs


@query(
    "compare_stores",
    "B12 W18",
    f"""
    WITH {MONTHLY},
    s AS (SELECT store_nbr, sum(revenue) AS rev FROM k WHERE age <= 3 GROUP BY 1)
    SELECT a.store_nbr AS store_1, b.store_nbr AS store_2, {r("a.rev")} AS revenue_1, {r("b.rev")} AS revenue_2,
           {r("CASE WHEN least(a.rev, b.rev) > 0 THEN (a.rev - b.rev) * 100 / b.rev END")} AS difference_pct,
           CASE WHEN a.rev > b.rev THEN a.store_nbr ELSE b.store_nbr END AS stronger_store
    FROM s a JOIN s b ON b.store_nbr = (a.store_nbr + 5) % 25
    """,
)
def compare_stores(t: RetailTables):
    return business.compare_stores(t.business, _store_pairs(t))


@query(
    "store_traffic",
    "B17",
    f"""
    WITH a AS (SELECT *, (SELECT max(date) FROM v_transactions) - date AS age FROM v_transactions),
    s AS (SELECT store_nbr, coalesce(sum(n_invoices) FILTER (age < 30), 0) AS now,
                 count(*) FILTER (age < 30) AS now_days,
                 coalesce(sum(n_invoices) FILTER (age >= 30 AND age < 60), 0) AS past,
                 count(*) FILTER (age >= 30 AND age < 60) AS past_days FROM a GROUP BY 1)
    SELECT store_nbr, CAST(now AS BIGINT) AS invoices_now, now_days AS active_days_now,
           CAST(past AS BIGINT) AS invoices_before, past_days AS active_days_before,
           {r("now / 30")} AS avg_per_day_now,
           {r("CASE WHEN past > 0 THEN (now - past) * 100.0 / past END")} AS trend_pct
    FROM s
    """,
)
def store_traffic(t: RetailTables):
    return business.store_traffic(t.transactions, 30)


def _impact_sql(keys: str) -> str:
    return f"""
    WITH s AS (SELECT {keys}, coalesce(sum(total_units) FILTER (onpromotion = 1), 0) AS u1,
                      coalesce(sum(item_day_rows) FILTER (onpromotion = 1), 0) AS n1,
                      coalesce(sum(total_units) FILTER (onpromotion = 0), 0) AS u0,
                      coalesce(sum(item_day_rows) FILTER (onpromotion = 0), 0) AS n0
               FROM v_promo_stats GROUP BY {keys}),
    l AS (SELECT *, u1 / n1 AS a, u0 / n0 AS b, (u1 / n1 - u0 / n0) / (u0 / n0) * 100 AS lift FROM s
          WHERE n1 > 0 AND n0 > 0 AND u0 > 0)
    SELECT {keys}, {r("a")} AS units_per_item_day_on, {r("b")} AS units_per_item_day_off, {r("lift")} AS lift_pct,
           CASE WHEN lift >= 20 THEN 'effective' WHEN lift > 0 THEN 'moderate' ELSE 'ineffective' END AS verdict
    FROM l
    """


@query("promotion_impact", "B18", _impact_sql("store_nbr, family"))
def promotion_impact(t: RetailTables):
    return business.promotion_impact(t.promo_stats)


@query("promotion_impact_store", "B18", _impact_sql("store_nbr"))
def promotion_impact_store(t: RetailTables):
    return business.promotion_impact(t.promo_stats, per_family=False)


@query(
    "promotion_days",
    "B18",
    "SELECT store_nbr, count(DISTINCT date) AS promo_days FROM v_sales WHERE onpromotion = 1 GROUP BY store_nbr",
)
def promotion_days(t: RetailTables):
    return business.promotion_days_all_families(t.cube)


@query(
    "gross_margin",
    "B20",
    f"""
    WITH {MONTHLY},
    g AS (SELECT *, CASE WHEN revenue > 0 THEN gross_profit * 100 / revenue END AS margin FROM k WHERE age <= 6)
    SELECT store_nbr, month, {r("revenue")} AS revenue, {r("returns")} AS returns, {r("cogs")} AS cogs,
           {r("gross_profit")} AS gross_profit, {r("margin")} AS margin_pct,
           {r("margin - lag(margin) OVER (PARTITION BY store_nbr ORDER BY month)")} AS change_pp
    FROM g
    """,
)
def gross_margin(t: RetailTables):
    return business.gross_margin(t.business, 6)


@query(
    "margin_ranking",
    "B20",
    f"""
    WITH s AS (SELECT store_nbr, sum(revenue) AS revenue, sum(returns) AS returns, sum(cogs) AS cogs FROM v_business
               WHERE date >= (SELECT max(date) FROM v_business) - INTERVAL 3 MONTH GROUP BY 1),
    g AS (SELECT *, revenue - returns - cogs AS gp FROM s),
    k AS (SELECT *, gp * 100 / revenue AS margin,
                 row_number() OVER (ORDER BY gp * 100 / revenue DESC, store_nbr) AS rank FROM g WHERE revenue > 0)
    SELECT store_nbr, {r("revenue")} AS revenue, {r("returns")} AS returns, {r("cogs")} AS cogs,
           {r("gp")} AS gross_profit, {r("margin")} AS margin_pct, CAST(rank AS INTEGER) AS rank
    FROM k WHERE rank <= 10
    """,
)
def margin_ranking(t: RetailTables):
    return business.margin_ranking(t.business)


@query(
    "revenue_bridge",
    "B21 W19 J14",
    f"""
    WITH m AS (SELECT store_nbr, strftime(date, '%Y-%m') AS month, sum(revenue) AS rev,
                      sum(coalesce(n_invoices, 0)) AS q
               FROM v_business LEFT JOIN v_transactions USING (date, store_nbr) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY month DESC) AS age FROM m),
    l AS (SELECT *, lag(month) OVER w AS month0, lag(rev) OVER w AS rev0, lag(q) OVER w AS q0
          FROM k WHERE age <= 6 WINDOW w AS (PARTITION BY store_nbr ORDER BY month)),
    e AS (SELECT *, rev - rev0 AS delta, (q - q0) * CASE WHEN q0 > 0 THEN rev0 / q0 ELSE 0 END AS volume,
                 (CASE WHEN q > 0 THEN rev / q ELSE 0 END - CASE WHEN q0 > 0 THEN rev0 / q0 ELSE 0 END) * q AS ticket
          FROM l WHERE month0 IS NOT NULL)
    SELECT store_nbr, month0 AS month_from, month AS month_to, {r("delta")} AS revenue_change,
           {r("volume")} AS volume_effect, {r("ticket")} AS ticket_effect,
           {r("delta - volume - ticket")} AS residual,
           CASE WHEN delta > 0 THEN 'up' ELSE 'down' END || ' by ' ||
           CASE WHEN abs(volume) >= abs(ticket) THEN 'traffic' ELSE 'ticket' END AS verdict
    FROM e
    """,
)
def revenue_bridge(t: RetailTables):
    return business.revenue_bridge(t.business, t.transactions, 6)


def _peer_sql(peers: str) -> str:
    """Store totals against the pooled totals of its peers."""
    return f"""
    WITH o AS (SELECT store_nbr, sum(revenue) AS revenue, sum(revenue) - sum(returns) - sum(cogs) AS gp,
                      coalesce(sum(n_invoices), 0) AS inv
               FROM v_business LEFT JOIN v_transactions USING (date, store_nbr)
               WHERE date >= (SELECT max(date) FROM v_business) - INTERVAL 3 MONTH GROUP BY 1),
    x AS (SELECT s.store_nbr, s.type, coalesce(revenue, 0) AS revenue, coalesce(gp, 0) AS gp, coalesce(inv, 0) AS inv
          FROM v_stores s LEFT JOIN o USING (store_nbr)),
    p AS (SELECT a.store_nbr, a.type, count(*) AS n, any_value(a.revenue) AS rev, any_value(a.gp) AS gp,
                 any_value(a.inv) AS inv, sum(b.revenue) AS prev, sum(b.gp) AS pgp, sum(b.inv) AS pinv
          FROM x a JOIN x b ON a.type = b.type AND a.store_nbr <> b.store_nbr AND {peers} GROUP BY ALL),
    f AS (SELECT store_nbr, type, n, rev, prev / n AS prev, gp, pgp / n AS pgp,
                 CASE WHEN rev > 0 THEN gp * 100 / rev ELSE 0 END AS mp,
                 CASE WHEN prev > 0 THEN pgp * 100 / prev ELSE 0 END AS pmp,
                 CASE WHEN inv > 0 THEN rev / inv ELSE 0 END AS tk,
                 CASE WHEN pinv > 0 THEN prev / pinv ELSE 0 END AS ptk FROM p)
    SELECT store_nbr, type, n AS peer_count, {r("rev")} AS revenue, {r("prev")} AS peer_revenue,
           {r("gp")} AS gross_profit, {r("pgp")} AS peer_gross_profit, {r("mp")} AS margin_pct,
           {r("pmp")} AS peer_margin_pct, {r("tk")} AS avg_ticket, {r("ptk")} AS peer_avg_ticket,
           {r("CASE WHEN prev > 0 THEN (rev - prev) * 100 / prev END")} AS revenue_vs_peer_pct,
           {r("CASE WHEN pgp > 0 THEN (gp - pgp) * 100 / pgp END")} AS gross_profit_vs_peer_pct,
           {r("CASE WHEN pmp > 0 THEN (mp - pmp) * 100 / pmp END")} AS margin_pct_vs_peer_pct,
           {r("CASE WHEN ptk > 0 THEN (tk - ptk) * 100 / ptk END")} AS avg_ticket_vs_peer_pct
    FROM f
    """


@query("peer_benchmark", "B22 J7", _peer_sql("TRUE"))
def peer_benchmark(t: RetailTables):
    return business.peer_benchmark(t.business, t.transactions, t.stores)


@query(
    "peer_benchmark_scoped",
    "B22 P20",
    _peer_sql("b.store_nbr IN (SELECT store_nbr FROM v_access WHERE username = 'region_asia')"),
)
def peer_benchmark_scoped(t: RetailTables):
    visible = scope.user_scope(t.access, "region_asia")
    return business.peer_benchmark(t.business, t.transactions, t.stores, scope=visible)


@query(
    "weekly_pattern",
    "B27",
    f"""
    WITH w AS (SELECT store_nbr, dayofweek(date) AS dow, avg(revenue) AS a, count(*) AS n FROM v_business
               WHERE date >= (SELECT max(date) FROM v_business) - 84 GROUP BY ALL),
    s AS (SELECT store_nbr, avg(a) FILTER (dow IN (0, 6)) AS we, avg(a) FILTER (dow NOT IN (0, 6)) AS wd FROM w GROUP BY 1),
    b AS (SELECT store_nbr, first(dow ORDER BY a DESC, dow) AS best, first(dow ORDER BY a, dow) AS worst FROM w GROUP BY 1)
    SELECT store_nbr, CAST(dow AS INTEGER) AS dow, {r("a")} AS avg_revenue, n AS days_observed,
           {r("we")} AS weekend_avg, {r("wd")} AS weekday_avg, CAST(best AS INTEGER) AS best_dow,
           CAST(worst AS INTEGER) AS worst_dow,
           {r("CASE WHEN wd > 0 THEN (we - wd) * 100 / wd END")} AS weekend_lift_pct
    FROM w JOIN s USING (store_nbr) JOIN b USING (store_nbr)
    """,
)
def weekly_pattern(t: RetailTables):
    return business.weekly_pattern(t.business)


GAP_SQL = """
    v AS (SELECT store_nbr, i.family, sum(unit_sales * unit_price) AS value
          FROM v_sold JOIN v_items i USING (item_nbr) JOIN v_item_prices p ON p.family = i.family GROUP BY ALL),
    g AS (SELECT store_nbr, family, value / sum(value) OVER (PARTITION BY store_nbr) * 100 AS s,
                 sum(value) OVER (PARTITION BY family) / sum(value) OVER () * 100 AS c FROM v)
"""


@query(
    "family_mix_gap",
    "B28",
    f"""
    WITH {GAP_SQL}
    SELECT store_nbr, family, {r("s")} AS store_share_pct, {r("c")} AS chain_share_pct, {r("s - c")} AS diff_pp FROM g
    """,
)
def family_mix_gap(t: RetailTables):
    return business.family_mix_gap(t.sold, t.items, t.prices)


@query(
    "family_mix_extremes",
    "B28",
    f"""
    WITH {GAP_SQL},
    e AS (SELECT *, s - c AS diff, CASE WHEN s - c < -1 THEN 'under' WHEN s - c > 1 THEN 'over' END AS side FROM g),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr, side ORDER BY abs(diff) DESC, family) AS rank
          FROM e WHERE side IS NOT NULL)
    SELECT store_nbr, family, {r("diff")} AS diff_pp, side, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8
    """,
)
def family_mix_extremes(t: RetailTables):
    gaps = business.family_mix_gap(t.sold, t.items, t.prices)
    return business.family_mix_extremes(gaps).drop("store_share_pct", "chain_share_pct")


@query(
    "store_profile",
    "B16 W18",
    f"""
    WITH {MONTHLY},
    n AS (SELECT store_nbr, count(*) AS managed FROM v_inventory GROUP BY 1)
    SELECT s.store_nbr, city, state, type, cluster, coalesce(managed, 0) AS managed_items, month AS latest_month,
           {r("revenue")} AS latest_revenue
    FROM v_stores s LEFT JOIN n USING (store_nbr) LEFT JOIN (SELECT * FROM k WHERE age = 1) USING (store_nbr)
    """,
)
def store_profile(t: RetailTables):
    return business.store_profile(t.stores, t.inventory, t.business)


@query(
    "store_top_families",
    "B16 K7",
    f"""
    WITH f AS (SELECT store_nbr, family, {r("sum(predicted_sales)")} AS u FROM v_family_forecast GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY u DESC, family) AS rank FROM f)
    SELECT store_nbr, family, {r("u")} AS forecast, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3
    """,
)
def store_top_families(t: RetailTables):
    return business.store_top_families(t.family_forecast)


@query(
    "cluster_trend",
    "B10",
    f"""
    WITH c AS (SELECT cluster, sum(predicted_sales) AS u FROM v_forecasts JOIN v_stores USING (store_nbr) GROUP BY 1)
    SELECT a.cluster AS cluster_1, b.cluster AS cluster_2, {r("a.u")} AS sales_1, {r("b.u")} AS sales_2,
           {r("CASE WHEN b.u <> 0 THEN (a.u - b.u) / b.u * 100 ELSE 0 END")} AS difference_pct,
           CASE WHEN a.u > b.u THEN a.cluster ELSE b.cluster END AS stronger_cluster
    FROM c a JOIN c b ON b.cluster = (a.cluster + 1) % 12
    """,
)
def cluster_trend(t: RetailTables):
    """Each cluster against the next one."""
    clusters = t.stores.select("cluster").distinct()
    pairs = clusters.select(
        F.col("cluster").alias("cluster_1"), ((F.col("cluster") + 1) % 12).cast("int").alias("cluster_2")
    )
    return business.cluster_trend(t.forecast_days, t.stores, pairs)


# ---------------------------------------------------------------- access


@query(
    "scoped_sales",
    "P20",
    f"""
    SELECT store_nbr, item_nbr, {r("unit_sales")} AS unit_sales FROM v_sold
    WHERE store_nbr IN (SELECT store_nbr FROM v_access WHERE username = 'region_europe')
    """,
)
def scoped_sales(t: RetailTables):
    return scope.scope(t.sold, t.access, "region_europe")


@query(
    "scoped_sales_one_store",
    "P20",
    f"SELECT store_nbr, item_nbr, {r('unit_sales')} AS unit_sales FROM v_sold WHERE store_nbr = 7",
)
def scoped_sales_one_store(t: RetailTables):
    return scope.scope(t.sold, t.access, "manager7", store_nbr=7)


@query(
    "scoped_revenue_by_user",
    "P20",
    f"""
    SELECT username, count(DISTINCT store_nbr) AS stores, {r("sum(revenue)")} AS revenue
    FROM v_access JOIN v_business USING (store_nbr) GROUP BY username
    """,
)
def scoped_revenue_by_user(t: RetailTables):
    by_store = t.business.groupBy("store_nbr").agg(F.sum("revenue").alias("revenue"))
    return scope.scope_by_user(by_store, t.access).groupBy("username").agg(
        F.count("store_nbr").alias("stores"), F.sum("revenue").alias("revenue")
    )


@query(
    "cluster_scope_check",
    "P21 U4",
    """
    SELECT store_nbr FROM v_stores WHERE cluster IN (3, 8)
    EXCEPT SELECT store_nbr FROM v_access WHERE username = 'region_europe'
    """,
)
def cluster_scope_check(t: RetailTables):
    """Stores of two clusters that a regional manager may not see."""
    involved = t.stores.filter(F.col("cluster").isin(3, 8))
    return scope.outside_scope(involved, t.access, "region_europe")
