"""Panel completion, calendar and series features.

Feature tables hold one row per series and day; the queries report them per series, with
sums over every row, so that each feature value counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import LOG_LAGS
from shelfcast.functions.series import SERIES_KEYS
from shelfcast.operators import enrich, features, panel
from shelfcast.operators.clean import forward_fill
from shelfcast.plans.registry import d, query, r
from shelfcast.plans.serving import RetailTables
from shelfcast.sources.testdata import COAST


def profile(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Known values and their mean, per series, for each column."""
    out = []
    for c in columns:
        out += [F.count(c).alias(f"{c}_n"), F.avg(F.col(c).cast("double")).alias(c)]
    return df.groupBy(*(keys or SERIES_KEYS)).agg(*out)


def profile_sql(source: str, columns: list[str], keys: str = "store_nbr, family") -> str:
    parts = [f"count({c}) AS {c}_n, {r(f'avg(CAST({c} AS DOUBLE))')} AS {c}" for c in columns]
    return f"SELECT {keys}, {', '.join(parts)} FROM {source} GROUP BY {keys}"


SERIES = "PARTITION BY store_nbr, family ORDER BY date"


def rolled(expr: str, stat: str, lag: int, width: int, need: int, over: str = SERIES) -> str:
    frame = f"({over} ROWS BETWEEN {lag + width - 1} PRECEDING AND {lag} PRECEDING)"
    return f"CASE WHEN count({expr}) OVER {frame} >= {need} THEN {stat}({expr}) OVER {frame} END"


@query(
    "complete_panel",
    "W6 J9 J10",
    f"""
    SELECT store_nbr, family, count(*) AS n_days, count(*) FILTER (observed) AS n_observed,
           {d("min(date)")} AS first_day, {d("max(date)")} AS last_day, {r("sum(target)")} AS units,
           CAST(sum(onpromotion) AS BIGINT) AS promo_days, count(DISTINCT perishable) AS perishables,
           count(*) FILTER (holiday_type <> 'Normal Day') AS holidays,
           count(*) FILTER (is_earthquake_period) AS quake_days, count(transactions_lag1) AS traffic_known,
           CAST(sum(transactions_lag1) AS BIGINT) AS traffic, {r("avg(oil_price)", 4)} AS oil,
           count(city) AS placed
    FROM v_panel GROUP BY store_nbr, family
    """,
    digits=4,
)
def complete_panel(t: RetailTables):
    return (
        panel.complete_panel(t.family_panel)
        .groupBy(*SERIES_KEYS)
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.count_if("observed").alias("n_observed"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
            F.sum("target").alias("units"),
            F.sum(F.col("onpromotion").cast("int")).alias("promo_days"),
            F.count_distinct("perishable").alias("perishables"),
            F.count_if(F.col("holiday_type") != "Normal Day").alias("holidays"),
            F.count_if("is_earthquake_period").alias("quake_days"),
            F.count("transactions_lag1").alias("traffic_known"),
            F.sum("transactions_lag1").alias("traffic"),
            F.avg("oil_price").alias("oil"),
            F.count("city").alias("placed"),
        )
    )


CALENDAR_SQL = """
    SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS dayofweek, CAST(month(date) AS INTEGER) AS month,
           CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
           CAST(day(date) AS INTEGER) AS dayofmonth, CAST((day(date) - 1) // 7 + 1 AS INTEGER) AS weekofmonth,
           CAST(dayofyear(date) AS INTEGER) AS dayofyear,
           CASE WHEN day(date) = 15 OR date = last_day(date) THEN 1 ELSE 0 END AS is_payday,
           CASE WHEN day(date) IN (1, 16) THEN 1 ELSE 0 END AS is_day_after_payday,
           CAST(day(date) - CASE WHEN day(date) >= 15 THEN 15 ELSE 0 END AS INTEGER) AS days_from_payday,
           CAST(CASE WHEN day(date) < 15 THEN 15 ELSE day(last_day(date)) END - day(date) AS INTEGER)
               AS days_to_payday,
           CASE WHEN day(date) <= 3 THEN 1 ELSE 0 END AS is_month_start,
           CASE WHEN day(last_day(date)) - day(date) <= 2 THEN 1 ELSE 0 END AS is_month_end
    FROM (SELECT DISTINCT date FROM v_panel)
"""


@query("calendar_features", "P8 P9", CALENDAR_SQL.replace("SELECT date,", f"SELECT {d('date')} AS date,", 1))
def calendar_features(t: RetailTables):
    days = t.panel.select("date").distinct()
    return enrich.with_calendar(enrich.with_date_parts(days))


@query(
    "back_to_school",
    "P10",
    """
    SELECT store_nbr, CAST(month(date) AS INTEGER) AS month,
           max(CASE WHEN (state IN ('AMERICA', 'ASIA') AND month(date) IN (4, 5))
                      OR (state NOT IN ('AMERICA', 'ASIA') AND month(date) IN (8, 9)) THEN 1 ELSE 0 END)
               AS is_back_to_school, count(*) AS n_rows
    FROM v_panel GROUP BY ALL
    """,
)
def back_to_school(t: RetailTables):
    flagged = enrich.with_back_to_school(t.panel, COAST)
    return flagged.groupBy("store_nbr", F.month("date").alias("month")).agg(
        F.max("is_back_to_school").alias("is_back_to_school"), F.count(F.lit(1)).alias("n_rows")
    )


BASE = [
    "sales_lag7",
    "sales_lag14",
    "sales_lag28",
    "sales_rolling_mean7",
    "sales_rolling_mean14",
    "sales_rolling_mean30",
    "sales_std7",
    "sales_std28",
    "is_holiday",
    "is_holiday_lag1",
    "is_holiday_lag2",
    "is_holiday_lead1",
    "is_holiday_lead2",
    "is_tier1_cluster",
]
_lags = ",\n".join(f"lag(target, {k}) OVER ({SERIES}) AS sales_lag{k}" for k in (7, 14, 28))
_means = ",\n".join(f"{rolled('target', 'avg', 1, w, w)} AS sales_rolling_mean{w}" for w in (7, 14, 30))
_stds = ",\n".join(f"{rolled('target', 'stddev_samp', 1, w, w)} AS sales_std{w}" for w in (7, 28))
_near = ",\n".join(
    f"coalesce({f}(h, {k}) OVER ({SERIES}), 0) AS is_holiday_{n}{k}"
    for f, n in (("lag", "lag"), ("lead", "lead"))
    for k in (1, 2)
)
BASE_SQL = f"""
    SELECT *, h AS is_holiday, CASE WHEN cluster IN (5, 11) THEN 1 ELSE 0 END AS is_tier1_cluster,
           {_lags}, {_means}, {_stds}, {_near}
    FROM (SELECT *, CASE WHEN holiday_type <> 'Normal Day' THEN 1 ELSE 0 END AS h FROM v_panel)
"""


@query("base_features", "M1 W1 W2 W3 W5", f"WITH b AS ({BASE_SQL}) {profile_sql('b', BASE)}")
def base_features(t: RetailTables):
    return profile(features.base_features(t.panel), BASE)


def _extended_sql(lag: int) -> str:
    weeks = -(-lag // 7)
    weekday = "PARTITION BY store_nbr, family, dow ORDER BY date"
    lags = ",\n".join(
        f"lag(s, {k}) OVER ({SERIES}) AS slog_lag{k}" for k in sorted({max(k, lag) for k in LOG_LAGS})
    )
    return f"""
        SELECT *, slog_roll_mean7 - slog_roll_mean28 AS slog_trend_7_28,
               slog_roll_mean7 / (slog_roll_mean28 + CAST(0.001 AS DOUBLE)) AS slog_ratio_7_28,
               least(coalesce(date - last_sale, 56), 56) AS days_since_sale
        FROM (SELECT *, {lags},
                {rolled("s", "avg", lag, 7, 2)} AS slog_roll_mean7,
                {rolled("s", "avg", lag, 14, 4)} AS slog_roll_mean14,
                {rolled("s", "avg", lag, 28, 9)} AS slog_roll_mean28,
                {rolled("s", "stddev_samp", lag, 7, 3)} AS slog_roll_std7,
                {rolled("s", "stddev_samp", lag, 28, 7)} AS slog_roll_std28,
                {rolled("z", "avg", lag, 7, 2)} AS zero_rate_7,
                {rolled("z", "avg", lag, 28, 7)} AS zero_rate_28,
                {rolled("onpromotion", "avg", lag, 7, 2)} AS promo_rate_7,
                {rolled("onpromotion", "avg", lag, 28, 7)} AS promo_rate_28,
                {rolled("s", "avg", weeks, 4, 1, weekday)} AS slog_dow_mean4,
                max(sold) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND {lag} PRECEDING) AS last_sale
              FROM (SELECT *, ln(1 + target) AS s, CASE WHEN target <= 0 THEN 1.0 ELSE 0.0 END AS z,
                           CASE WHEN target > 0 THEN date END AS sold, isodow(date) AS dow FROM v_panel))
    """


def _extended_columns(lag: int) -> list[str]:
    return [c for c in features.extended_names(lag, traffic=False) if c not in features.CALENDAR_FEATURES]


for _lag in (1, 16):

    @query(
        f"extended_features_lag{_lag}",
        "M2 P13 W7 W8 W9 W10 W11 W12 W13",
        f"WITH e AS ({_extended_sql(_lag)}) {profile_sql('e', _extended_columns(_lag))}",
    )
    def extended_features(t: RetailTables, lag=_lag):
        return profile(features.extended_features(t.panel, lag), _extended_columns(lag))


@query(
    "cross_series_features",
    "W14",
    f"""
    WITH p AS (SELECT *, ln(1 + target) AS s FROM v_panel),
    sd AS (SELECT store_nbr, date, avg(onpromotion) AS store_promo_share,
                  lag(avg(s), 7) OVER (PARTITION BY store_nbr ORDER BY date) AS store_slog_mean_lag
           FROM p GROUP BY store_nbr, date),
    fd AS (SELECT family, date, lag(avg(s), 7) OVER (PARTITION BY family ORDER BY date) AS family_slog_mean_lag
           FROM p GROUP BY family, date),
    e AS (SELECT p.store_nbr, p.family, store_promo_share, store_slog_mean_lag, family_slog_mean_lag
          FROM p JOIN sd USING (store_nbr, date) JOIN fd USING (family, date))
    {profile_sql("e", features.CROSS_FEATURES)}
    """,
)
def cross_series_features(t: RetailTables):
    return profile(features.extended_features(t.panel, 7, cross=True), features.CROSS_FEATURES)


@query(
    "traffic_mean",
    "W15",
    f"""
    SELECT store_nbr, {d("date")} AS date,
           {r(rolled("n_invoices", "avg", 1, 7, 2, "PARTITION BY store_nbr ORDER BY date"))} AS trans_roll_mean7
    FROM v_transactions
    """,
)
def traffic_mean(t: RetailTables):
    return features.traffic_mean(t.transactions, 1)


@query(
    "warm_up_trim",
    "W24",
    f"""
    SELECT store_nbr, family, count(*) AS n_days, {d("min(p.date)")} AS first_day, {r("sum(target)")} AS units
    FROM v_panel p JOIN (SELECT store_nbr, family, min(date) AS f FROM v_panel GROUP BY ALL) USING (store_nbr, family)
    WHERE p.date >= f + 44 GROUP BY store_nbr, family
    """,
)
def warm_up_trim(t: RetailTables):
    kept = panel.trim_warm_up(t.panel, min_lag=16)
    return kept.groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_day"), F.sum("target").alias("units")
    )


@query(
    "traffic_forward_fill",
    "W23",
    f"""
    WITH dd AS (SELECT store_nbr, CAST(unnest(generate_series((SELECT min(date) FROM v_transactions),
                        (SELECT origin + 16 FROM v_origin), INTERVAL 1 DAY)) AS DATE) AS date FROM v_stores),
    f AS (SELECT dd.store_nbr, dd.date, last_value(n_invoices IGNORE NULLS) OVER (
                     PARTITION BY dd.store_nbr ORDER BY dd.date ROWS UNBOUNDED PRECEDING) AS transactions
          FROM dd LEFT JOIN v_transactions t ON t.store_nbr = dd.store_nbr AND t.date = dd.date)
    SELECT store_nbr, strftime(date, '%Y-%m') AS month, count(*) AS n_days, count(transactions) AS known,
           CAST(sum(transactions) AS BIGINT) AS transactions FROM f GROUP BY ALL
    """,
)
def traffic_forward_fill(t: RetailTables):
    """Store traffic on every day up to the end of the horizon, last known value carried on."""
    first = t.transactions.agg(F.min("date")).scalar()
    days = t.stores.select(
        "store_nbr", F.explode(F.sequence(first, F.date_add(t.origin, t.horizon))).alias("date")
    )
    known = t.transactions.select("store_nbr", "date", "transactions")
    filled = forward_fill(days.join(known, ["store_nbr", "date"], "left"), ["store_nbr"], ["transactions"])
    return filled.groupBy("store_nbr", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("transactions").alias("known"),
        F.sum("transactions").alias("transactions"),
    )


IMPUTED = ["sales_lag28", "sales_std28", "slog_lag28", "slog_roll_std28", "slog_ratio_7_28"]


@query(
    "imputed_features",
    "P14",
    f"""
    WITH e AS ({_extended_sql(1)}),
    b AS (SELECT store_nbr, family, coalesce(lag(target, 28) OVER ({SERIES}), 0) AS sales_lag28,
                 coalesce({rolled('target', 'stddev_samp', 1, 28, 28)}, 0) AS sales_std28,
                 coalesce(slog_lag28, -1) AS slog_lag28, coalesce(slog_roll_std28, -1) AS slog_roll_std28,
                 coalesce(slog_ratio_7_28, -1) AS slog_ratio_7_28
          FROM e)
    {profile_sql("b", IMPUTED)}
    """,
)
def imputed_features(t: RetailTables):
    both = features.extended_features(features.base_features(t.panel), 1)
    return profile(features.impute(both, 1), IMPUTED)


@query(
    "ordinal_codes",
    "P15",
    """
    WITH seen AS (SELECT DISTINCT family, city FROM v_panel WHERE store_nbr < 20),
    f AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS code FROM (SELECT DISTINCT family FROM seen)),
    c AS (SELECT city, row_number() OVER (ORDER BY city) - 1 AS code FROM (SELECT DISTINCT city FROM seen))
    SELECT p.family, p.city, CAST(coalesce(f.code, 9999) AS INTEGER) AS family_code,
           CAST(coalesce(c.code, 9999) AS INTEGER) AS city_code, count(*) AS n_rows
    FROM v_panel p LEFT JOIN f USING (family) LEFT JOIN c USING (city) GROUP BY ALL
    """,
)
def ordinal_codes(t: RetailTables):
    """Codes learned on stores below 20; the cities of other stores are unknown to them."""
    train = t.panel.filter("store_nbr < 20")
    coded = features.encode_ordinal(train, t.panel, ["family", "city"])
    return coded.groupBy("family", "city", "family_code", "city_code").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "safe_feature_report",
    "P16",
    f"""
    SELECT feature, count(*) AS n_rows, {r("avg(v)")} AS mean
    FROM (SELECT 'sales_lag28' AS feature, lag(target, 28) OVER ({SERIES}) AS v FROM v_panel)
    GROUP BY feature
    """,
)
def safe_feature_report(t: RetailTables):
    """Base lag features that may be used at a 16-day look-ahead, with their mean."""
    built = features.base_features(t.panel)
    safe = features.select_features(built.columns, 16)["zero_filled"]
    lagged = [c for c in safe if c in features.BASE_FEATURE_LAGS]
    reports = [
        built.groupBy(F.lit(c).alias("feature")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(c).alias("mean"))
        for c in lagged
    ]
    return reduce(DataFrame.unionByName, reports)
