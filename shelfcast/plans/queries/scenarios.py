"""What-if scenarios: one per store and family, with overrides that vary by store."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions.series import SERIES_KEYS
from shelfcast.operators import scenario
from shelfcast.plans.queries.forecasting import CHECK_DRIVERS, check_drivers, check_models, recursive_sql
from shelfcast.plans.registry import d, query, r
from shelfcast.plans.serving import RetailTables

# Every series gets a scenario; some parameters fall outside their range on purpose.
OVERRIDES_SQL = """
    allov AS (
        SELECT store_nbr * 100 + ascii(family) + length(family) AS scenario_id, store_nbr, family,
               7 + store_nbr % 10 AS horizon_days,
               CASE WHEN store_nbr = 24 THEN CAST(11 AS DOUBLE)
                    ELSE CAST(0.5 AS DOUBLE) + (store_nbr % 5) * CAST(0.5 AS DOUBLE) END AS demand_multiplier,
               CASE WHEN store_nbr % 3 = 0 THEN NULL ELSE store_nbr % 17 END AS promo_days,
               CASE WHEN store_nbr % 4 = 0 THEN NULL ELSE CAST(15 + store_nbr * 5 AS DOUBLE) END AS oil_price,
               CASE WHEN store_nbr % 5 = 0 THEN NULL ELSE CAST(store_nbr * 10 - 90 AS DOUBLE) END AS traffic_change_pct,
               CASE store_nbr % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'holiday' WHEN 2 THEN 'earthquake'
                    ELSE CASE WHEN store_nbr = 23 THEN 'flood' ELSE 'none' END END AS event_type,
               store_nbr % 7 AS event_days,
               CASE WHEN store_nbr % 6 = 0 THEN CAST(store_nbr * 3 AS DOUBLE) END AS stock_override,
               CASE WHEN store_nbr % 8 = 0 THEN CAST(store_nbr AS DOUBLE) END AS lead_time_override
        FROM (SELECT DISTINCT store_nbr, family FROM v_panel)),
    ranges AS (
        SELECT *, list_filter([
                   CASE WHEN horizon_days < 7 OR horizon_days > 16 THEN 'horizon_days' END,
                   CASE WHEN demand_multiplier < 0 OR demand_multiplier > 10 THEN 'demand_multiplier' END,
                   CASE WHEN promo_days < 0 OR promo_days > 16 THEN 'promo_days' END,
                   CASE WHEN oil_price < 20 OR oil_price > 200 THEN 'oil_price' END,
                   CASE WHEN traffic_change_pct < -90 OR traffic_change_pct > 200 THEN 'traffic_change_pct' END,
                   CASE WHEN event_type NOT IN ('none', 'holiday', 'earthquake') THEN 'event_type' END],
                   lambda x: x IS NOT NULL) AS rejected
        FROM allov),
    ov AS (SELECT * FROM ranges WHERE len(rejected) = 0)
"""


def _overrides(t: RetailTables):
    s = F.col("store_nbr")
    raw = t.family_prediction.select(*SERIES_KEYS).distinct().select(
        (s * 100 + F.ascii("family") + F.length("family")).cast("long").alias("scenario_id"),
        "store_nbr",
        "family",
        (7 + s % 10).alias("horizon_days"),
        F.when(s == 24, 11.0).otherwise(0.5 + (s % 5) * 0.5).alias("demand_multiplier"),
        F.when(s % 3 != 0, s % 17).alias("promo_days"),
        F.when(s % 4 != 0, 15 + s * 5).alias("oil_price"),
        F.when(s % 5 != 0, s * 10 - 90).alias("traffic_change_pct"),
        F.when(s % 4 == 1, "holiday")
        .when(s % 4 == 2, "earthquake")
        .when(s == 23, "flood")
        .alias("event_type"),
        (s % 7).alias("event_days"),
        F.when(s % 6 == 0, s * 3).alias("stock_override"),
        F.when(s % 8 == 0, s).alias("lead_time_override"),
    )
    return scenario.with_defaults(raw)


def _valid(t: RetailTables):
    return scenario.valid_overrides(_overrides(t))


@query(
    "scenario_parameters",
    "Q9",
    f"""
    WITH {OVERRIDES_SQL}
    SELECT scenario_id, store_nbr, family, horizon_days, {r("demand_multiplier")} AS demand_multiplier,
           array_to_string(rejected, ',') AS rejected
    FROM ranges
    """,
)
def scenario_parameters(t: RetailTables):
    checked = scenario.check_overrides(_overrides(t))
    return checked.select(
        "scenario_id",
        "store_nbr",
        "family",
        "horizon_days",
        "demand_multiplier",
        F.array_join("rejected", ",").alias("rejected"),
    )


HISTORY_SQL = """
    hist AS (
        SELECT p.store_nbr, p.family, p.date, greatest(p.units, 0) AS target, p.onpromotion, p.perishable,
               coalesce(n.h.holiday_type, g.h.holiday_type, l.h.holiday_type, 'Normal Day') AS holiday_type,
               o.oil_price, t.transactions_lag1
        FROM (SELECT store_nbr, family, date, sum(unit_sales) AS units, max(onpromotion) AS onpromotion,
                     max(perishable) AS perishable
              FROM v_sales JOIN v_items USING (item_nbr), v_origin WHERE date > origin - 90 GROUP BY ALL) p
        JOIN v_stores s USING (store_nbr) LEFT JOIN v_oil o USING (date)
        LEFT JOIN v_hol_level n ON n.locale = 'National' AND n.date = p.date
        LEFT JOIN v_hol_level g ON g.locale = 'Regional' AND g.date = p.date AND g.place = s.state
        LEFT JOIN v_hol_level l ON l.locale = 'Local' AND l.date = p.date AND l.place = s.city
        LEFT JOIN v_traffic_lag t ON t.store_nbr = p.store_nbr AND t.date = p.date),
    traffic AS (SELECT store_nbr, CAST(max_by(transactions_lag1, date) AS DOUBLE) AS last_traffic
                FROM (SELECT DISTINCT store_nbr, date, transactions_lag1 FROM hist WHERE transactions_lag1 IS NOT NULL)
                GROUP BY 1)
"""


def _history(t: RetailTables):
    return t.stored(
        "scenario_history",
        lambda: scenario.history(
            t.recent_sales(scenario.HISTORY_DAYS), t.stores, t.items, t.oil, t.holidays, t.transactions, t.origin
        ),
    )


@query(
    "scenario_history",
    "Q1",
    f"""
    WITH {HISTORY_SQL}
    SELECT store_nbr, family, {d("date")} AS date, {r("target", 4)} AS target, onpromotion = 1 AS onpromotion, perishable,
           holiday_type, {r("oil_price", 4)} AS oil_price, transactions_lag1 FROM hist
    """,
    digits=4,
)
def scenario_history(t: RetailTables):
    return _history(t).select(
        *SERIES_KEYS, "date", "target", "onpromotion", "perishable", "holiday_type", "oil_price", "transactions_lag1"
    )


DRIVERS_SQL = f"""
    {OVERRIDES_SQL}, {HISTORY_SQL},
    days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_index
             FROM (SELECT DISTINCT date FROM v_forecasts)),
    drv AS (
        SELECT ov.scenario_id, ov.store_nbr, ov.family, d.date, d.day_index,
               CASE WHEN promo_days IS NOT NULL THEN CASE WHEN day_index < promo_days THEN 1 ELSE 0 END
                    ELSE coalesce(p.onpromotion, 0) END AS onpromotion,
               coalesce(ov.oil_price, o.oil_price) AS oil_price,
               CASE WHEN day_index < event_days AND event_type = 'holiday' THEN 'Holiday'
                    WHEN day_index < event_days AND event_type = 'earthquake' THEN 'Event'
                    ELSE coalesce(n.h.holiday_type, g.h.holiday_type, l.h.holiday_type, 'Normal Day') END AS holiday_type,
               CASE WHEN day_index < event_days AND event_type = 'holiday' THEN FALSE
                    WHEN day_index < event_days AND event_type = 'earthquake' THEN TRUE
                    ELSE lower(coalesce(n.h.holiday_description, g.h.holiday_description, l.h.holiday_description, ''))
                         LIKE '%terremoto%' END AS is_earthquake_period,
               CASE WHEN traffic_change_pct IS NOT NULL
                    THEN greatest(0, coalesce(last_traffic, 0) * greatest(0, 1 + traffic_change_pct / 100)) END
                   AS transactions_lag1,
               coalesce(p.onpromotion, 0) AS plan_promotion, o.oil_price AS plan_oil,
               coalesce(n.h.holiday_type, g.h.holiday_type, l.h.holiday_type, 'Normal Day') AS plan_type,
               lower(coalesce(n.h.holiday_description, g.h.holiday_description, l.h.holiday_description, ''))
                   LIKE '%terremoto%' AS plan_quake, last_traffic AS plan_traffic
        FROM ov JOIN days d ON d.day_index < horizon_days
        JOIN v_stores s ON s.store_nbr = ov.store_nbr
        LEFT JOIN v_oil o ON o.date = d.date
        LEFT JOIN v_planned p ON p.date = d.date AND p.store_nbr = ov.store_nbr AND p.family = ov.family
        LEFT JOIN v_hol_level n ON n.locale = 'National' AND n.date = d.date
        LEFT JOIN v_hol_level g ON g.locale = 'Regional' AND g.date = d.date AND g.place = s.state
        LEFT JOIN v_hol_level l ON l.locale = 'Local' AND l.date = d.date AND l.place = s.city
        LEFT JOIN traffic tr ON tr.store_nbr = ov.store_nbr)
"""


def _drivers(t: RetailTables):
    return scenario.future_drivers(
        _valid(t),
        scenario.window_days(t.forecast_days),
        t.stores,
        t.oil,
        t.holidays,
        t.planned_promotions,
        scenario.latest_traffic(_history(t)),
    )


@query(
    "scenario_drivers",
    "Q2",
    f"""
    WITH {DRIVERS_SQL}
    SELECT scenario_id, store_nbr, family, {d("date")} AS date, CAST(day_index AS INTEGER) AS day_index, onpromotion,
           {r("oil_price", 4)} AS oil_price, holiday_type, is_earthquake_period,
           {r("transactions_lag1", 4)} AS transactions_lag1 FROM drv
    """,
    digits=4,
)
def scenario_drivers(t: RetailTables):
    return _drivers(t).select(
        "scenario_id", *SERIES_KEYS, "date", "day_index", "onpromotion", "oil_price", "holiday_type", "is_earthquake_period", "transactions_lag1"
    )


BASE_SQL = """
    base AS (SELECT scenario_id, ov.store_nbr, ov.family, f.date, f.predicted_sales AS baseline_sales
             FROM ov JOIN v_family_forecast f ON f.store_nbr = ov.store_nbr AND f.family = ov.family
             JOIN days ON days.date = f.date AND day_index < horizon_days)
"""


@query(
    "scenario_baseline",
    "Q3",
    f"""
    WITH {DRIVERS_SQL}, {BASE_SQL}
    SELECT scenario_id, store_nbr, family, {d("date")} AS date, {r("baseline_sales")} AS baseline_sales FROM base
    """,
)
def scenario_baseline(t: RetailTables):
    return scenario.baseline(t.family_forecast, _valid(t), scenario.window_days(t.forecast_days))


STOCK_SQL = """
    stk AS (SELECT store_nbr, family, sum(current_stock) AS stock, avg(lead_time_days) AS lead_time, count(*) AS sku_count
            FROM v_inventory JOIN v_items USING (item_nbr) GROUP BY ALL),
    up AS (SELECT f.family, CASE WHEN p.unit_price > 0 THEN p.unit_price ELSE 5.0 END AS unit_price
           FROM (SELECT DISTINCT family FROM v_items) f LEFT JOIN v_prices p ON upper(p.family) = upper(f.family))
"""


@query(
    "scenario_family_stock",
    "Q4",
    f"""
    WITH {STOCK_SQL}
    SELECT store_nbr, s.family, {r("stock")} AS stock, {r("lead_time")} AS lead_time, sku_count,
           {r("unit_price")} AS unit_price FROM stk s JOIN up ON up.family = s.family
    """,
)
def scenario_family_stock(t: RetailTables):
    stock = scenario.family_stock(t.inventory, t.items)
    return stock.join(scenario.unit_prices(t.items, t.prices), "family")


def _effect_sql() -> str:
    """What the overridden drivers add to the plan's, with the check coefficients."""

    def value(kind: str, quake: str) -> str:
        return f"CASE WHEN {kind} <> 'Normal Day' AND NOT {quake} THEN 1.0 ELSE 0.0 END"

    moved = {
        "oil": "coalesce(oil_price, 0) / 100 - coalesce(plan_oil, 0) / 100",
        "holiday": f"{value('holiday_type', 'is_earthquake_period')} - {value('plan_type', 'plan_quake')}",
        "quake": "CAST(is_earthquake_period AS INTEGER) - CAST(plan_quake AS INTEGER)",
        "traffic": "ln(1 + greatest(coalesce(transactions_lag1, plan_traffic, 0), 0)) - ln(1 + greatest(coalesce(plan_traffic, 0), 0))",
    }
    return " + ".join(f"CAST({CHECK_DRIVERS[c]} AS DOUBLE) * ({x})" for c, x in moved.items())


# The model part of a run: one recursion over each scenario's own drivers and over the plan's.
RUN_SQL = f"""
    {DRIVERS_SQL}, {BASE_SQL}, {STOCK_SQL},
    fut AS (SELECT scenario_id, TRUE AS changed, store_nbr, family, date, CAST(onpromotion AS DOUBLE) AS promo, {_effect_sql()} AS effect FROM drv
            UNION ALL
            SELECT scenario_id, FALSE, store_nbr, family, date, CAST(plan_promotion AS DOUBLE), 0 FROM drv),
    {recursive_sql("fut", "(SELECT max(date) FROM v_panel)", "scenario_id, changed, store_nbr, family", effect=True)},
    tot AS (
        SELECT ov.*, b.baseline_total, coalesce(stock_override, stk.stock, 0) AS stock,
               coalesce(lead_time_override, stk.lead_time, 3) AS lead_time, coalesce(up.unit_price, 5) AS unit_price,
               CASE WHEN m.change IS NOT NULL THEN 'model' ELSE 'scaled baseline' END AS source,
               greatest(b.baseline_total + coalesce(m.change, 0), 0) * demand_multiplier AS scenario_total
        FROM ov JOIN (SELECT scenario_id, sum(baseline_sales) AS baseline_total FROM base GROUP BY 1) b USING (scenario_id)
        LEFT JOIN (SELECT scenario_id, sum(CASE WHEN changed THEN pred END) - sum(CASE WHEN NOT changed THEN pred END) AS change
                   FROM rolled GROUP BY 1) m USING (scenario_id)
        LEFT JOIN stk ON stk.store_nbr = ov.store_nbr AND stk.family = ov.family
        LEFT JOIN up ON up.family = ov.family),
    outc AS (
        SELECT *, scenario_total / horizon_days AS daily, greatest(0, scenario_total - stock) AS short,
               CASE WHEN scenario_total > 0 THEN least(999, stock / (scenario_total / horizon_days)) ELSE 999 END AS cover
        FROM tot)
"""


def _run(t: RetailTables):
    return scenario.run_scenarios(
        _valid(t),
        t.panel,
        check_models(t),
        t.family_forecast,
        _drivers(t),
        scenario.window_days(t.forecast_days),
        t.inventory,
        t.items,
        t.prices,
        check_drivers(t),
    )


OUTCOME_COLUMNS = [
    "scenario_id",
    "source",
    "horizon_days",
    "baseline_total",
    "scenario_total",
    "delta",
    "delta_pct",
    "stock",
    "lead_time",
    "unit_price",
    "days_of_cover",
    "shortfall",
    "excess",
    "will_stockout",
    "overstock",
    "expected_revenue",
    "baseline_revenue",
    "lost_revenue",
    "risk_level",
    "verdict",
]


@query(
    "scenario_runs",
    "B7 Q5 Q7",
    f"""
    WITH RECURSIVE {RUN_SQL}
    SELECT scenario_id, source, horizon_days, {r("baseline_total")} AS baseline_total,
           {r("scenario_total")} AS scenario_total, {r("scenario_total - baseline_total")} AS delta,
           {r("CASE WHEN baseline_total > 0 THEN (scenario_total - baseline_total) * 100 / baseline_total END")}
               AS delta_pct,
           {r("stock")} AS stock, {r("lead_time")} AS lead_time, {r("unit_price")} AS unit_price,
           {r("cover")} AS days_of_cover, {r("short")} AS shortfall, {r("greatest(0, stock - scenario_total)")} AS excess,
           short > 0 AS will_stockout, short <= 0 AND cover > 30 AND scenario_total > 0 AS overstock,
           {r("scenario_total * unit_price")} AS expected_revenue, {r("baseline_total * unit_price")} AS baseline_revenue,
           {r("short * unit_price")} AS lost_revenue,
           CASE WHEN short > 0 THEN CASE WHEN short / greatest(stock, 1) > 2 THEN 'very high'
                                         WHEN short / greatest(stock, 1) > 1 THEN 'high'
                                         WHEN short / greatest(stock, 1) > 0.3 THEN 'medium' ELSE 'low' END
                WHEN cover > 30 AND scenario_total > 0 THEN 'overstock' ELSE 'safe' END AS risk_level,
           CASE WHEN short > 0 THEN 'stock-out ahead' WHEN cover > 30 AND scenario_total > 0 THEN 'overstocked'
                ELSE 'enough stock' END AS verdict
    FROM outc
    """,
)
def scenario_runs(t: RetailTables):
    return _run(t).select(*OUTCOME_COLUMNS)


@query(
    "scenario_item_movements",
    "Q6 K7",
    f"""
    WITH RECURSIVE {RUN_SQL},
    sh AS (SELECT store_nbr, item_nbr, family, u / total AS share
           FROM (SELECT *, sum(u) OVER (PARTITION BY store_nbr, family) AS total
                 FROM (SELECT store_nbr, item_nbr, family, sum(predicted_sales) AS u
                       FROM v_forecasts JOIN v_items USING (item_nbr) GROUP BY ALL)) WHERE total > 0),
    mv AS (SELECT scenario_id, tot.store_nbr, sh.item_nbr, baseline_total * share AS b, scenario_total * share AS n,
                  coalesce(v.current_stock, 0) AS st
           FROM tot JOIN sh ON sh.store_nbr = tot.store_nbr AND sh.family = tot.family
           LEFT JOIN v_inventory v ON v.store_nbr = tot.store_nbr AND v.item_nbr = sh.item_nbr),
    k AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY {r("abs(n - b)")} DESC, item_nbr) AS rank FROM mv)
    SELECT scenario_id, store_nbr, item_nbr, {r("b")} AS item_baseline, {r("n")} AS item_scenario,
           {r("n - b")} AS item_delta, {r("CASE WHEN b > 0 THEN (n - b) * 100 / b END")} AS item_delta_pct,
           {r("greatest(0, n - st)")} AS item_shortfall, CAST(rank AS INTEGER) AS rank
    FROM k WHERE rank <= 8
    """,
)
def scenario_item_movements(t: RetailTables):
    return scenario.sku_movements(_run(t), t.forecasts, t.items, t.inventory)


@query(
    "scenario_form_defaults",
    "Q8",
    f"""
    WITH {HISTORY_SQL}, {STOCK_SQL},
    pd AS (SELECT store_nbr, family, sum(onpromotion) AS n FROM v_planned GROUP BY ALL)
    SELECT s.store_nbr, s.family, {r("stock", 4)} AS stock, {r("lead_time", 4)} AS lead_time, sku_count,
           {r("unit_price", 4)} AS unit_price, CAST(coalesce(pd.n, 0) AS BIGINT) AS baseline_promo_days,
           {r("(SELECT max_by(oil_price, date) FROM v_oil WHERE date <= (SELECT origin + 1 FROM v_origin))", 4)}
               AS current_oil_price, {r("coalesce(last_traffic, 0)", 4)} AS last_transactions
    FROM stk s JOIN up ON up.family = s.family
    LEFT JOIN pd ON pd.store_nbr = s.store_nbr AND pd.family = s.family
    LEFT JOIN traffic t ON t.store_nbr = s.store_nbr
    """,
    digits=4,
)
def scenario_form_defaults(t: RetailTables):
    return scenario.form_defaults(
        t.inventory,
        t.items,
        t.prices,
        t.planned_promotions,
        t.oil,
        _history(t),
        F.date_add(t.origin, 1),
    )


@query("scenario_sensitivity", "B7 Q7")
def scenario_sensitivity(t: RetailTables):
    """All series under the fitted models, once for each kind of override: what each one moves."""
    series = t.panel.select(*SERIES_KEYS).distinct()
    kinds = {
        "neutral": {},
        "oil": {"oil_price": F.lit(200.0)},
        "traffic": {"traffic_change_pct": F.lit(-90.0)},
        "holiday": {"event_type": F.lit("holiday"), "event_days": F.lit(16)},
        "earthquake": {"event_type": F.lit("earthquake"), "event_days": F.lit(16)},
        "promotion": {"promo_days": F.lit(16)},
    }
    wanted = None
    for kind, changes in kinds.items():
        key = F.xxhash64(F.lit(kind), *SERIES_KEYS).alias("scenario_id")
        rows = scenario.with_defaults(series.select(key, *SERIES_KEYS, *[c.alias(n) for n, c in changes.items()]))
        rows = rows.withColumn("kind", F.lit(kind))
        wanted = rows if wanted is None else wanted.unionByName(rows)
    overrides = wanted.drop("kind")
    days = scenario.window_days(t.forecast_days)
    drivers = scenario.future_drivers(
        overrides, days, t.stores, t.oil, t.holidays, t.planned_promotions, scenario.latest_traffic(_history(t))
    )
    ran = scenario.run_scenarios(
        overrides, t.panel, t.local_models, t.family_forecast, drivers, days, t.inventory, t.items, t.prices, t.driver_models
    )
    return ran.join(wanted.select("scenario_id", "kind"), "scenario_id").groupBy("kind").agg(
        F.count(F.lit(1)).alias("scenarios"), F.sum("baseline_total").alias("baseline_total"), F.sum("scenario_total").alias("scenario_total"),
        F.sum("delta").alias("delta"),
    )
