"""The serving tables again, as DuckDB SQL over the order tables, for checking results."""

from __future__ import annotations

from shelfcast.constants import DEFAULT_COST_RATIO, DEFAULT_PRICE, DEFAULT_RETURN_RATE
from shelfcast.sources.testdata import HOLIDAYS, UNPRICED


def _values(rows: list[tuple]) -> str:
    def literal(v):
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS DOUBLE)"

    return ",\n".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


PANEL_COLUMNS = "store_nbr, family, date"

VIEWS = {
    "v_stores": """
        SELECT n_nationkey AS store_nbr, n_name AS city, r_name AS state,
               substr('ABCDE', CAST(n_nationkey % 5 AS INTEGER) + 1, 1) AS type,
               n_nationkey % 12 AS cluster
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_items": """
        SELECT p_partkey AS item_nbr, p_type AS family, p_size AS class,
               CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS perishable, p_name AS name
        FROM part""",
    "v_origin": """
        SELECT CAST(max(l_shipdate) AS DATE) - 16 AS origin FROM lineitem""",
    "v_raw": """
        SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store_nbr, l_partkey AS item_nbr,
               CASE WHEN l_returnflag = 'R' AND l_discount > 0.085
                    THEN -l_quantity * (CASE WHEN l_linenumber = 7 THEN 10 ELSE 1 END)
                    ELSE l_quantity END AS unit_sales,
               CASE WHEN l_discount < 0.005 THEN NULL WHEN l_discount > 0.065 THEN 1 ELSE 0 END AS onpromotion
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "v_raw_history": """
        SELECT v_raw.* FROM v_raw, v_origin WHERE date <= origin""",
    "v_sales": """
        SELECT date, store_nbr, item_nbr, greatest(unit_sales, 0) AS unit_sales,
               coalesce(onpromotion, 0) AS onpromotion
        FROM v_raw_history""",
    "v_transactions": """
        SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store_nbr,
               count(DISTINCT l_orderkey) AS n_invoices
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE CAST(l_shipdate AS DATE) <= (SELECT origin FROM v_origin)
        GROUP BY ALL""",
    "v_raw_oil": """
        SELECT CAST(o_orderdate AS DATE) AS date,
               CASE WHEN day(CAST(o_orderdate AS DATE)) % 7 IN (5, 6) THEN NULL
                    ELSE avg(o_totalprice) / 5000 END AS dcoilwtico
        FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    "v_oil": """
        SELECT date,
               coalesce(last_value(p IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING),
                        first_value(p IGNORE NULLS) OVER (ORDER BY date
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS oil_price
        FROM (SELECT s.date, o.dcoilwtico AS p
              FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM v_raw_oil),
                        (SELECT origin FROM v_origin) + 16, INTERVAL 1 DAY)) AS DATE) AS date) s
              LEFT JOIN v_raw_oil o USING (date))""",
    "v_prices": f"""
        SELECT CASE WHEN p_type = 'LARGE' THEN lower(p_type) ELSE p_type END AS family,
               max(p_retailprice) / (length(p_type) * 50) AS unit_price,
               6e-1 + count(*) % 7 * 3e-2 AS cost_ratio, 1e-2 + count(*) % 5 * 5e-3 AS return_rate
        FROM part WHERE p_type <> '{UNPRICED}' GROUP BY p_type""",
    "v_item_prices": f"""
        SELECT f.family, coalesce(p.unit_price, CAST({DEFAULT_PRICE} AS DOUBLE)) AS unit_price,
               coalesce(p.cost_ratio, CAST({DEFAULT_COST_RATIO} AS DOUBLE)) AS cost_ratio,
               coalesce(p.return_rate, CAST({DEFAULT_RETURN_RATE} AS DOUBLE)) AS return_rate
        FROM (SELECT DISTINCT family FROM v_items) f
        LEFT JOIN v_prices p ON upper(f.family) = upper(p.family)""",
    "v_raw_holidays": f"""
        SELECT CAST(date AS DATE) AS date, type, locale, locale_name, description, transferred
        FROM (VALUES {_values(HOLIDAYS)}) t(date, type, locale, locale_name, description, transferred)""",
    "v_holidays": """
        SELECT date, locale, locale_name, type AS holiday_type, description AS holiday_description
        FROM v_raw_holidays WHERE NOT transferred""",
    "v_hol_level": """
        SELECT date, locale, CASE WHEN locale = 'National' THEN '' ELSE locale_name END AS place,
               min(struct_pack(holiday_type := holiday_type, holiday_description := holiday_description)) AS h
        FROM v_holidays GROUP BY ALL""",
    "v_access": """
        SELECT 'manager' || CAST(store_nbr AS VARCHAR) AS username, store_nbr FROM v_stores
        UNION ALL SELECT 'region_' || lower(state), store_nbr FROM v_stores""",
    "v_sold": """
        SELECT store_nbr, item_nbr, sum(unit_sales) AS unit_sales FROM v_sales GROUP BY ALL""",
    "v_business": """
        SELECT s.date, s.store_nbr, sum(unit_sales * unit_price) AS revenue,
               sum(unit_sales * unit_price * return_rate) AS returns,
               sum(unit_sales * (1 - return_rate) * unit_price * cost_ratio) AS cogs
        FROM v_sales s JOIN v_items i USING (item_nbr) JOIN v_item_prices p ON p.family = i.family
        GROUP BY ALL""",
    "v_promo_stats": """
        SELECT store_nbr, family, onpromotion, count(*) AS item_day_rows, sum(unit_sales) AS total_units,
               count(DISTINCT date) AS promo_days
        FROM v_sales JOIN v_items USING (item_nbr) GROUP BY ALL""",
    "v_history": """
        SELECT date, family, perishable, sum(unit_sales) AS unit_sales
        FROM v_sales JOIN v_items USING (item_nbr) GROUP BY ALL""",
    "v_clean": """
        SELECT r.date, r.store_nbr, r.item_nbr, r.unit_sales, coalesce(r.onpromotion, 0) AS onpromotion
        FROM v_raw_history r
        JOIN (SELECT item_nbr, max(unit_sales) AS item_max FROM v_raw_history GROUP BY 1) m USING (item_nbr)
        WHERE NOT (r.unit_sales < 0 AND abs(r.unit_sales) > item_max)""",
    "v_traffic_lag": """
        SELECT store_nbr, date,
               CAST(lag(n_invoices) OVER (PARTITION BY store_nbr ORDER BY date) AS INTEGER) AS transactions_lag1
        FROM v_transactions""",
    "v_family_panel": """
        SELECT p.store_nbr, p.family, p.date, p.unit_sales, p.onpromotion, p.perishable,
               s.city, s.state, s.type, s.cluster, o.oil_price,
               coalesce(n.h.holiday_type, g.h.holiday_type, l.h.holiday_type, 'Normal Day') AS holiday_type,
               lower(coalesce(n.h.holiday_description, g.h.holiday_description,
                              l.h.holiday_description, 'None')) LIKE '%terremoto%' AS is_earthquake_period,
               t.transactions_lag1, greatest(p.unit_sales, 0) AS target
        FROM (SELECT store_nbr, family, date, sum(unit_sales) AS unit_sales,
                     max(onpromotion) AS onpromotion, max(perishable) AS perishable
              FROM v_clean JOIN v_items USING (item_nbr) GROUP BY ALL) p
        JOIN v_stores s USING (store_nbr)
        LEFT JOIN v_oil o USING (date)
        LEFT JOIN v_hol_level n ON n.locale = 'National' AND n.date = p.date
        LEFT JOIN v_hol_level g ON g.locale = 'Regional' AND g.date = p.date AND g.place = s.state
        LEFT JOIN v_hol_level l ON l.locale = 'Local' AND l.date = p.date AND l.place = s.city
        LEFT JOIN v_traffic_lag t ON t.store_nbr = p.store_nbr AND t.date = p.date""",
    "v_grid": """
        SELECT store_nbr, family, CAST(unnest(generate_series(start_day,
                   (SELECT max(date) FROM v_family_panel), INTERVAL 1 DAY)) AS DATE) AS date
        FROM (SELECT store_nbr, family, min(date) AS start_day FROM v_family_panel GROUP BY ALL)""",
    "v_panel": """
        SELECT g.store_nbr, g.family, g.date, coalesce(p.unit_sales, 0) AS unit_sales,
               coalesce(p.onpromotion, 0) AS onpromotion, coalesce(p.perishable, sf.perishable) AS perishable,
               st.city, st.state, st.type, st.cluster,
               coalesce(p.oil_price, dd.oil_price) AS oil_price,
               coalesce(p.holiday_type, sd.holiday_type, dd.day_holiday, 'Normal Day') AS holiday_type,
               coalesce(p.is_earthquake_period, dd.quake, FALSE) AS is_earthquake_period,
               coalesce(p.transactions_lag1, sd.transactions_lag1) AS transactions_lag1,
               coalesce(p.target, 0) AS target, p.date IS NOT NULL AS observed
        FROM v_grid g
        LEFT JOIN v_family_panel p ON p.store_nbr = g.store_nbr AND p.family = g.family AND p.date = g.date
        JOIN v_stores st ON st.store_nbr = g.store_nbr
        LEFT JOIN (SELECT store_nbr, family, max(perishable) AS perishable FROM v_family_panel GROUP BY ALL) sf
               ON sf.store_nbr = g.store_nbr AND sf.family = g.family
        LEFT JOIN (SELECT store_nbr, date, max(holiday_type) AS holiday_type,
                          max(transactions_lag1) AS transactions_lag1 FROM v_family_panel GROUP BY ALL) sd
               ON sd.store_nbr = g.store_nbr AND sd.date = g.date
        LEFT JOIN (SELECT date, max(oil_price) AS oil_price, bool_or(is_earthquake_period) AS quake,
                          min(CASE WHEN holiday_type <> 'Normal Day' THEN holiday_type END) AS day_holiday
                   FROM v_family_panel GROUP BY ALL) dd ON dd.date = g.date""",
    "v_horizon": """
        SELECT CAST(unnest(generate_series(origin + 1, origin + 16, INTERVAL 1 DAY)) AS DATE) AS date
        FROM v_origin""",
    "v_plan": """
        SELECT (h.date - o.origin) * 144115188075855872 + CAST(a.store_nbr AS BIGINT) * 137438953472
                   + a.item_nbr AS id,
               h.date, a.store_nbr, a.item_nbr, f.onpromotion
        FROM (SELECT DISTINCT store_nbr, item_nbr FROM v_sales) a
        CROSS JOIN v_horizon h CROSS JOIN v_origin o
        LEFT JOIN (SELECT date, store_nbr, item_nbr, max(onpromotion) AS onpromotion FROM v_raw, v_origin
                   WHERE date > origin GROUP BY ALL) f
               ON f.date = h.date AND f.store_nbr = a.store_nbr AND f.item_nbr = a.item_nbr""",
    "v_share_level": """
        SELECT store_nbr, item_nbr, family, avg(unit_sales) AS level, sum(unit_sales) AS total
        FROM v_sales JOIN v_items USING (item_nbr), v_origin
        WHERE date >= origin - 45 GROUP BY ALL""",
    "v_shares": """
        SELECT store_nbr, item_nbr, family,
               least(greatest(coalesce(level / nullif(sum(level) OVER (PARTITION BY store_nbr, family), 0), 0), 0), 1)
                   AS share
        FROM v_share_level""",
    "v_family_prediction": """
        SELECT s.store_nbr, s.family, h.date, coalesce(w.prediction, 0) AS prediction
        FROM (SELECT DISTINCT store_nbr, family FROM v_panel) s CROSS JOIN v_horizon h
        LEFT JOIN (SELECT store_nbr, family, isodow(date) AS dow, avg(target) AS prediction
                   FROM v_panel WHERE date > (SELECT max(date) FROM v_panel) - 28 GROUP BY ALL) w
               ON w.store_nbr = s.store_nbr AND w.family = s.family AND w.dow = isodow(h.date)""",
    "v_forecasts": """
        SELECT p.id, p.store_nbr, p.item_nbr, p.date,
               greatest(coalesce(f.prediction, 0) * coalesce(s.share, 0), 0) AS predicted_sales
        FROM v_plan p JOIN v_items i USING (item_nbr)
        LEFT JOIN v_family_prediction f ON f.store_nbr = p.store_nbr AND f.family = i.family AND f.date = p.date
        LEFT JOIN v_shares s ON s.store_nbr = p.store_nbr AND s.item_nbr = p.item_nbr""",
    "v_family_forecast": """
        SELECT store_nbr, date, family, floor(sum(predicted_sales) * 1e6 + 0.50003) / 1e6 AS predicted_sales
        FROM v_forecasts JOIN v_items USING (item_nbr) GROUP BY ALL""",
    "v_demand": """
        SELECT store_nbr, item_nbr, floor(sum(predicted_sales) * 1e6 + 0.50003) / 1e6 AS forecast,
               floor(avg(predicted_sales) * 1e6 + 0.50003) / 1e6 AS daily_demand
        FROM v_forecasts GROUP BY ALL""",
    "v_policy": """
        SELECT store_nbr, item_nbr, lead_time_days,
               CASE WHEN state <= 5 THEN lead_time_days + 4 WHEN state <= 7 THEN state - 5
                    ELSE 30 + (11 * store_nbr + 5 * item_nbr) % 15 END AS coverage_days
        FROM (SELECT store_nbr, item_nbr, (31 * store_nbr + 17 * item_nbr) % 7 + 1 AS lead_time_days,
                     (7 * store_nbr + 13 * item_nbr) % 10 AS state FROM v_demand)""",
    "v_inventory": """
        SELECT store_nbr, item_nbr,
               greatest(floor(daily_demand * coverage_days + 0.5 + 1e-9), 0) AS current_stock,
               CAST(lead_time_days AS INTEGER) AS lead_time_days
        FROM v_demand JOIN v_policy USING (store_nbr, item_nbr)""",
    "v_position": """
        SELECT d.store_nbr, d.item_nbr, d.forecast, d.daily_demand, v.current_stock, v.lead_time_days,
               i.name, i.family, i.perishable
        FROM v_demand d JOIN v_inventory v USING (store_nbr, item_nbr) JOIN v_items i USING (item_nbr)""",
    "v_item_windows": """
        SELECT item_nbr,
               sum(CASE WHEN year(date) = year(origin) - 1 THEN unit_sales ELSE 0 END) AS sold_year,
               sum(unit_sales) AS hist_total,
               sum(CASE WHEN date > origin - 90 AND date <= origin - 45 THEN unit_sales ELSE 0 END) AS w0_total,
               sum(CASE WHEN date > origin - 45 THEN unit_sales ELSE 0 END) AS w1_total
        FROM v_sales, v_origin GROUP BY item_nbr""",
    "v_chain_abc": """
        SELECT item_nbr, hist_total, cum_value, total_value,
               CASE WHEN cum_value <= CAST(0.80 AS DOUBLE) * total_value THEN 'A'
                    WHEN cum_value <= CAST(0.95 AS DOUBLE) * total_value THEN 'B' ELSE 'C' END AS abc_class
        FROM (SELECT item_nbr, hist_total, sum(hist_total) OVER () AS total_value,
                     sum(hist_total) OVER (ORDER BY hist_total DESC, item_nbr ROWS UNBOUNDED PRECEDING) AS cum_value
              FROM v_item_windows)""",
    "v_sku": """
        SELECT i.item_nbr, i.family, i.class AS class_code, i.perishable,
               coalesce(w.sold_year, 0) AS sold_year, coalesce(w.hist_total, 0) AS hist_total,
               coalesce(w.w1_total, 0) / 45 AS avg_daily_45d, coalesce(w.w0_total, 0) AS w0_total,
               coalesce(w.w1_total, 0) AS w1_total, coalesce(f.fc, 0) AS fc_total_16d,
               coalesce(a.abc_class, 'C') AS abc_class, CAST(0.357 AS DOUBLE) AS family_rmsle
        FROM v_items i LEFT JOIN v_item_windows w USING (item_nbr)
        LEFT JOIN (SELECT item_nbr, sum(predicted_sales) AS fc FROM v_forecasts GROUP BY 1) f USING (item_nbr)
        LEFT JOIN v_chain_abc a USING (item_nbr)""",
    "v_planned": """
        SELECT date, store_nbr, family, max(coalesce(onpromotion, 0)) AS onpromotion
        FROM v_plan JOIN v_items USING (item_nbr) GROUP BY ALL""",
}
