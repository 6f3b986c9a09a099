"""Joins, serving aggregates and class tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import aggregates, business, enrich, insights
from shelfcast.operators.encoding import ClusterEncoding
from shelfcast.plans.registry import d, query, r
from shelfcast.plans.serving import RetailTables


@query(
    "star_enrichment",
    "J1",
    f"""
    SELECT state, type, family, perishable, count(*) AS n_rows, {r("sum(unit_sales)")} AS units,
           {r("avg(oil_price)", 4)} AS avg_oil
    FROM v_sales LEFT JOIN v_stores USING (store_nbr) LEFT JOIN v_items USING (item_nbr)
    LEFT JOIN v_oil USING (date) GROUP BY ALL
    """,
    digits=4,
)
def star_enrichment(t: RetailTables):
    rows = enrich.star(t.sales, t.stores, t.items, t.oil)
    return rows.groupBy("state", "type", "family", "perishable").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("unit_sales").alias("units"), F.avg("oil_price").alias("avg_oil")
    )


@query(
    "holiday_join",
    "J2",
    f"""
    SELECT {d("p.date")} AS date, p.store_nbr, p.n_rows,
           coalesce(n.h.holiday_type, g.h.holiday_type, l.h.holiday_type, 'Normal Day') AS holiday_type,
           coalesce(n.h.holiday_description, g.h.holiday_description, l.h.holiday_description, 'None')
               AS holiday_description
    FROM (SELECT date, store_nbr, count(*) AS n_rows FROM v_sales GROUP BY ALL) p
    JOIN v_stores s USING (store_nbr)
    LEFT JOIN v_hol_level n ON n.locale = 'National' AND n.date = p.date
    LEFT JOIN v_hol_level g ON g.locale = 'Regional' AND g.date = p.date AND g.place = s.state
    LEFT JOIN v_hol_level l ON l.locale = 'Local' AND l.date = p.date AND l.place = s.city
    """,
)
def holiday_join(t: RetailTables):
    days = t.sales.groupBy("date", "store_nbr").agg(F.count(F.lit(1)).alias("n_rows"))
    placed = days.join(t.stores.select("store_nbr", "city", "state"), "store_nbr")
    return enrich.join_holidays(placed, t.holidays).drop("city", "state")


@query(
    "traffic_lag",
    "J3 W4",
    f"SELECT store_nbr, {d('date')} AS date, transactions_lag1 FROM v_traffic_lag WHERE transactions_lag1 IS NOT NULL",
)
def traffic_lag(t: RetailTables):
    return enrich.transactions_lag(t.transactions).filter("transactions_lag1 IS NOT NULL")


@query(
    "priced_items",
    "J5",
    f"""
    SELECT item_nbr, i.family, {r("unit_price")} AS unit_price, {r("cost_ratio")} AS cost_ratio,
           {r("return_rate")} AS return_rate
    FROM v_items i JOIN v_item_prices p ON p.family = i.family
    """,
)
def priced_items(t: RetailTables):
    return enrich.join_prices(t.items.select("item_nbr", "family"), t.prices)


@query(
    "family_panel",
    "A1",
    f"""
    SELECT store_nbr, family, {d("date")} AS date, {r("unit_sales")} AS unit_sales, onpromotion = 1 AS onpromotion,
           perishable, holiday_type, is_earthquake_period, cluster, {r("target")} AS target
    FROM v_family_panel
    """,
)
def family_panel(t: RetailTables):
    return t.family_panel.select(
        "store_nbr",
        "family",
        "date",
        "unit_sales",
        "onpromotion",
        "perishable",
        "holiday_type",
        "is_earthquake_period",
        "cluster",
        "target",
    )


@query("item_store_sales", "A2", f"SELECT store_nbr, item_nbr, {r('unit_sales')} AS unit_sales FROM v_sold")
def item_store_sales(t: RetailTables):
    return t.sold


@query(
    "forecast_by_family",
    "A3",
    f"""
    SELECT store_nbr, {d("date")} AS date, family, {r("predicted_sales")} AS predicted_sales FROM v_family_forecast
    """,
)
def forecast_by_family(t: RetailTables):
    return t.family_forecast


@query(
    "daily_business",
    "A4",
    f"""
    SELECT {d("date")} AS date, store_nbr, {r("revenue")} AS revenue, {r("returns")} AS returns, {r("cogs")} AS cogs
    FROM v_business
    """,
)
def daily_business(t: RetailTables):
    return t.business


@query(
    "promotion_stats",
    "A5",
    f"""
    SELECT store_nbr, family, onpromotion, item_day_rows, {r("total_units")} AS total_units, promo_days
    FROM v_promo_stats
    """,
)
def promotion_stats(t: RetailTables):
    return t.promo_stats


@query(
    "item_windows",
    "A6",
    f"""
    SELECT item_nbr, {r("sold_year")} AS sold_year, {r("hist_total")} AS hist_total, {r("w0_total")} AS w0_total,
           {r("w1_total")} AS w1_total FROM v_item_windows
    """,
)
def item_windows(t: RetailTables):
    return aggregates.item_windows(t.sales, t.origin_date.year - 1, t.origin)


@query(
    "sku_stats",
    "A7",
    f"""
    SELECT item_nbr, family, class_code, perishable, {r("sold_year")} AS sold_year, {r("hist_total")} AS hist_total,
           {r("avg_daily_45d")} AS avg_daily_45d, {r("w0_total")} AS w0_total, {r("w1_total")} AS w1_total,
           {r("fc_total_16d")} AS fc_total_16d, abc_class, {r("family_rmsle")} AS family_rmsle
    FROM v_sku
    """,
)
def sku_stats(t: RetailTables):
    return t.sku_stats


@query(
    "chain_abc",
    "W16",
    f"""
    SELECT item_nbr, {r("hist_total")} AS hist_total, {r("cum_value")} AS cum_value,
           {r("total_value")} AS total_value, abc_class FROM v_chain_abc
    """,
)
def chain_abc(t: RetailTables):
    totals = aggregates.item_windows(t.sales, t.origin_date.year - 1, t.origin).select("item_nbr", "hist_total")
    return aggregates.abc_classes(totals, "hist_total")


@query(
    "stability_by_class",
    "W27",
    f"""
    WITH m AS (SELECT abc_class, (w1_total - w0_total) / w0_total * 100 AS dev FROM v_sku WHERE w0_total > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY abc_class ORDER BY dev) AS rn,
                 count(*) OVER (PARTITION BY abc_class) AS n FROM m)
    SELECT abc_class, count(*) AS n, {r("avg(abs(dev))")} AS mean_abs_dev_pct,
           {r("avg(CASE WHEN abs(dev) <= 30 THEN 100.0 ELSE 0.0 END)")} AS pct_within_30,
           {r("max(CASE WHEN rn = n // 2 + 1 THEN dev END)")} AS median_dev_pct
    FROM k GROUP BY abc_class
    """,
)
def stability_by_class(t: RetailTables):
    return aggregates.stability_by_class(t.sku_stats)


@query(
    "item_shares",
    "W17",
    f"SELECT store_nbr, item_nbr, family, {r('share')} AS share FROM v_shares",
)
def item_shares(t: RetailTables):
    return t.shares


@query(
    "item_shares_blended",
    "W17",
    f"""
    WITH p AS (
        SELECT store_nbr, item_nbr, coalesce(level / nullif(sum(level) OVER (PARTITION BY store_nbr, family), 0), 0)
                   AS past
        FROM (SELECT store_nbr, item_nbr, family, avg(unit_sales) AS level
              FROM v_sales JOIN v_items USING (item_nbr), v_origin
              WHERE date >= origin - 410 AND date <= origin - 365 GROUP BY ALL))
    SELECT store_nbr, item_nbr, family,
           {r("least(greatest(0.7 * share + 0.3 * coalesce(past, share), 0), 1)")} AS share
    FROM v_shares LEFT JOIN p USING (store_nbr, item_nbr)
    """,
)
def item_shares_blended(t: RetailTables):
    return aggregates.item_shares(t.sales, t.items, t.origin, year_ago_weight=0.3)


@query(
    "item_shares_by_sum",
    "W17",
    f"""
    SELECT store_nbr, item_nbr, family,
           {r("coalesce(total / nullif(sum(total) OVER (PARTITION BY store_nbr, family), 0), 0)")} AS share
    FROM v_share_level
    """,
)
def item_shares_by_sum(t: RetailTables):
    return aggregates.item_shares(t.sales, t.items, t.origin, by_sum=True)


@query(
    "item_shares_from_forecast",
    "W17 Q6",
    f"""
    SELECT store_nbr, item_nbr, family, {r("u / total")} AS share
    FROM (SELECT *, sum(u) OVER (PARTITION BY store_nbr, family) AS total
          FROM (SELECT store_nbr, item_nbr, family, sum(predicted_sales) AS u
                FROM v_forecasts JOIN v_items USING (item_nbr) GROUP BY ALL))
    WHERE total > 0
    """,
)
def item_shares_from_forecast(t: RetailTables):
    return aggregates.shares_from_forecasts(t.forecast_totals, t.items)


ENCODING_SQL = """
    SELECT *, avg(target) OVER () AS g FROM v_panel
"""


@query(
    "cluster_encoding",
    "A9",
    f"""
    WITH p AS ({ENCODING_SQL})
    SELECT cluster,
           {r("(avg(target) * count(*) + any_value(g) * 10) / (count(*) + 10)")} AS cluster_mean_sales,
           {r("(median(target) * count(*) + any_value(g) * 10) / (count(*) + 10)")} AS cluster_median_sales,
           {r("stddev_samp(target)")} AS cluster_std_sales
    FROM p GROUP BY cluster
    """,
)
def cluster_encoding(t: RetailTables):
    return ClusterEncoding.fit(t.panel).by_cluster


@query(
    "cluster_encoding_range_median",
    "A9",
    f"""
    WITH p AS ({ENCODING_SQL})
    SELECT cluster,
           {r("(avg(target) * count(*) + any_value(g) * 10) / (count(*) + 10)")} AS cluster_mean_sales,
           {r("(median(target) * count(*) + any_value(g) * 10) / (count(*) + 10)")} AS cluster_median_sales,
           {r("stddev_samp(target)")} AS cluster_std_sales
    FROM p GROUP BY cluster
    """,
)
def cluster_encoding_range_median(t: RetailTables):
    """The same table with the median found by range-partitioned running counts."""
    return ClusterEncoding.fit(t.panel).by_cluster


@query(
    "encoded_panel",
    "A9 P11 P12",
    f"""
    WITH p AS ({ENCODING_SQL}),
    c AS (SELECT cluster, (avg(target) * count(*) + any_value(g) * 10) / (count(*) + 10) AS m,
                 (median(target) * count(*) + any_value(g) * 10) / (count(*) + 10) AS md,
                 stddev_samp(target) AS sd FROM p GROUP BY 1),
    f AS (SELECT cluster, family, (avg(target) * count(*) + any_value(g) * 10) / (count(*) + 10) AS mf
          FROM p GROUP BY 1, 2),
    o AS (SELECT cluster, onpromotion, (avg(target) * count(*) + any_value(g) * 10) / (count(*) + 10) AS mp
          FROM p GROUP BY 1, 2)
    SELECT store_nbr, family, count(*) AS n_rows, {r("avg(m)")} AS cluster_mean_sales,
           {r("avg(md)")} AS cluster_median_sales, {r("avg(sd)")} AS cluster_std_sales,
           {r("avg(mf)")} AS cluster_family_mean_sales, {r("avg(mp)")} AS cluster_promo_mean_sales,
           {r("avg(mp / (m + 1e-8))")} AS cluster_promo_lift,
           {r("avg(CASE WHEN cluster IN (5, 11) THEN 1 ELSE 0 END)")} AS tier1
    FROM p JOIN c USING (cluster) JOIN f USING (cluster, family) JOIN o USING (cluster, onpromotion)
    GROUP BY store_nbr, family
    """,
)
def encoded_panel(t: RetailTables):
    coded = enrich.with_tier_flag(ClusterEncoding.fit(t.panel).apply(t.panel))
    names = [
        "cluster_mean_sales",
        "cluster_median_sales",
        "cluster_std_sales",
        "cluster_family_mean_sales",
        "cluster_promo_mean_sales",
        "cluster_promo_lift",
    ]
    return coded.groupBy("store_nbr", "family").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(c).alias(c) for c in names],
        F.avg("is_tier1_cluster").alias("tier1"),
    )


@query(
    "tier_split",
    "P11",
    f"""
    SELECT CASE WHEN cluster IN (5, 11) THEN 'tier 1' ELSE 'other' END AS tier, count(*) AS n_rows,
           {r("sum(target)")} AS units
    FROM v_panel GROUP BY 1
    """,
)
def tier_split(t: RetailTables):
    first, rest = enrich.split_by_tier(t.panel)
    both = first.withColumn("tier", F.lit("tier 1")).unionByName(rest.withColumn("tier", F.lit("other")))
    return both.groupBy("tier").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("target").alias("units"))


@query(
    "future_promotions",
    "A10",
    f"SELECT {d('date')} AS date, store_nbr, family, onpromotion FROM v_planned",
)
def future_promotions(t: RetailTables):
    return t.planned_promotions


@query(
    "future_promotion_days",
    "A10",
    "SELECT store_nbr, family, CAST(sum(onpromotion) AS BIGINT) AS promo_days FROM v_planned GROUP BY ALL",
)
def future_promotion_days(t: RetailTables):
    return aggregates.promotion_days(t.planned_promotions)


@query(
    "business_history",
    "A15 J14",
    f"""
    SELECT {d("date")} AS date, CAST(coalesce(sum(n_invoices), 0) AS BIGINT) AS invoices,
           {r("sum(revenue)")} AS revenue, {r("sum(returns)")} AS returns, {r("sum(cogs)")} AS cogs,
           {r("sum(revenue) - sum(returns) - sum(cogs)")} AS gross_profit
    FROM v_business LEFT JOIN v_transactions USING (date, store_nbr) GROUP BY date
    """,
)
def business_history(t: RetailTables):
    return aggregates.business_history(t.business, t.transactions)


def _period_sql(grain: str) -> str:
    return {
        "day": "strftime(date, '%Y-%m-%d')",
        "month": "strftime(date, '%Y-%m')",
        "quarter": "strftime(date, '%Y') || '-Q' || CAST(quarter(date) AS VARCHAR)",
    }[grain]


for _grain in ("day", "month", "quarter"):

    @query(
        f"units_by_{_grain}",
        "A20 W20",
        f"""
        WITH u AS (SELECT {_period_sql(_grain)} AS period, sum(unit_sales) AS total,
                          sum(CASE WHEN perishable = 1 THEN unit_sales ELSE 0 END) AS p
                   FROM v_history GROUP BY 1),
        l AS (SELECT *, lag(total) OVER (ORDER BY period) AS before FROM u)
        SELECT period, {r("total")} AS total, {r("p")} AS perishable_units, {r("total - p")} AS durable_units,
               {r("CASE WHEN before > 0 THEN (total - before) * 100 / before END")} AS growth_pct
        FROM l
        """,
    )
    def units_by_period(t: RetailTables, grain=_grain):
        return insights.period_growth(aggregates.period_units(t.history, grain))


@query(
    "family_units_by_quarter",
    "A20",
    f"""
    SELECT {_period_sql("quarter")} AS period, family, {r("sum(unit_sales)")} AS units FROM v_history GROUP BY 1, 2
    """,
)
def family_units_by_quarter(t: RetailTables):
    return aggregates.period_family_units(t.history, "quarter")


@query(
    "business_by_quarter",
    "A21",
    f"""
    SELECT {_period_sql("quarter")} AS period, CAST(coalesce(sum(n_invoices), 0) AS BIGINT) AS invoices,
           {r("sum(revenue)")} AS revenue, {r("sum(returns)")} AS returns, {r("sum(cogs)")} AS cogs,
           {r("sum(revenue) - sum(returns)")} AS net, {r("sum(revenue) - sum(returns) - sum(cogs)")} AS gross
    FROM v_business LEFT JOIN v_transactions USING (date, store_nbr) GROUP BY 1
    """,
)
def business_by_quarter(t: RetailTables):
    return aggregates.period_business(aggregates.business_history(t.business, t.transactions), "quarter")


@query(
    "day_detail",
    "W21",
    f"""
    WITH u AS (SELECT date, sum(unit_sales) AS total FROM v_history GROUP BY 1),
    l AS (SELECT *, lag(total) OVER (ORDER BY date) AS before,
                 avg(total) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS week FROM u)
    SELECT {d("date")} AS date, {r("total")} AS total,
           {r("CASE WHEN before > 0 THEN (total - before) * 100 / before END")} AS vs_previous_pct,
           {r("CASE WHEN week > 0 THEN (total - week) * 100 / week END")} AS vs_week_pct
    FROM l
    """,
)
def day_detail(t: RetailTables):
    return insights.day_detail(t.history)


@query(
    "day_top_families",
    "W21",
    f"""
    WITH u AS (SELECT date, family, sum(unit_sales) AS units FROM v_history GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY units DESC, family) AS rank FROM u)
    SELECT {d("date")} AS date, family, {r("units")} AS units, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3
    """,
)
def day_top_families(t: RetailTables):
    return insights.day_top_families(t.history, 3)


@query(
    "half_change_by_family",
    "W22",
    f"""
    WITH u AS (SELECT strftime(date, '%Y-%m') AS period, family, sum(unit_sales) AS units FROM v_history GROUP BY ALL),
    p AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS pos, count(*) OVER () AS n
          FROM (SELECT DISTINCT period FROM u)),
    s AS (SELECT family, sum(CASE WHEN pos < n // 2 THEN units ELSE 0 END) AS first_half,
                 sum(CASE WHEN pos >= n // 2 THEN units END) AS second_half
          FROM u JOIN p USING (period) GROUP BY family)
    SELECT family, {r("first_half")} AS first_half, {r("second_half")} AS second_half,
           {r("(second_half - first_half) * 100 / first_half")} AS change_pct
    FROM s WHERE first_half >= 500
    """,
)
def half_change_by_family(t: RetailTables):
    return insights.half_year_change(t.history)


@query(
    "insights",
    "W22",
    f"""
    WITH u AS (SELECT strftime(date, '%Y-%m') AS period, family, perishable, date, unit_sales FROM v_history),
    p AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS pos, count(*) OVER () AS n
          FROM (SELECT DISTINCT period FROM u)),
    s AS (SELECT family, sum(CASE WHEN pos < n // 2 THEN unit_sales ELSE 0 END) AS a,
                 sum(CASE WHEN pos >= n // 2 THEN unit_sales END) AS b FROM u JOIN p USING (period) GROUP BY family),
    c AS (SELECT family, (b - a) * 100 / a AS v FROM s WHERE a >= 500),
    dd AS (SELECT date, sum(unit_sales) AS units FROM u GROUP BY date),
    f AS (SELECT family, sum(unit_sales) AS units FROM u GROUP BY family),
    m AS (SELECT period, sum(unit_sales) AS total FROM u GROUP BY period),
    g AS (SELECT period, total, lag(total) OVER (ORDER BY period) AS before FROM m)
    SELECT 'fastest family' AS kind, 'good' AS tone, family AS subject, {r("v")} AS value
    FROM (SELECT * FROM c ORDER BY v DESC, family DESC LIMIT 1) WHERE v > 5
    UNION ALL SELECT 'slowest family', 'bad', family, {r("v")} FROM (SELECT * FROM c ORDER BY v, family LIMIT 1)
              WHERE v < -5
    UNION ALL SELECT 'peak day', 'info', strftime(date, '%Y-%m-%d'), {r("units")}
              FROM (SELECT * FROM dd ORDER BY units DESC, date LIMIT 1)
    UNION ALL SELECT 'perishable share', 'warn', 'perishable', {r("v")}
              FROM (SELECT sum(CASE WHEN perishable = 1 THEN unit_sales ELSE 0 END) / sum(unit_sales) * 100 AS v FROM u)
              WHERE v >= 30
    UNION ALL SELECT 'leading family', CASE WHEN v >= 40 THEN 'warn' ELSE 'info' END, family, {r("v")}
              FROM (SELECT family, units / (SELECT sum(units) FROM f) * 100 AS v FROM f
                    ORDER BY units DESC, family DESC LIMIT 1)
    UNION ALL SELECT 'last period', CASE WHEN total >= before THEN 'good' ELSE 'bad' END, period,
                     {r("(total - before) * 100 / before")}
              FROM (SELECT * FROM g ORDER BY period DESC LIMIT 1) WHERE before > 0
    """,
)
def insights_report(t: RetailTables):
    return insights.insights(t.history)


@query(
    "business_trend_months",
    "B11",
    f"""
    SELECT store_nbr, strftime(date, '%Y-%m') AS month, {r("sum(revenue)")} AS revenue,
           {r("sum(returns)")} AS returns, {r("sum(cogs)")} AS cogs,
           {r("sum(revenue) - sum(returns) - sum(cogs)")} AS gross_profit
    FROM v_business GROUP BY 1, 2
    """,
)
def business_trend_months(t: RetailTables):
    return business.monthly_business(t.business, ["store_nbr"])
