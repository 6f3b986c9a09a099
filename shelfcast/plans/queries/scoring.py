"""Forecast scores, folds, blend weights, audits and data profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions.series import SERIES_KEYS
from shelfcast.operators import features, metrics
from shelfcast.plans.queries.features import _extended_columns, _extended_sql
from shelfcast.plans.registry import d, query, r
from shelfcast.plans.serving import RetailTables

KEYS = [*SERIES_KEYS, "date"]


def score_sql(source: str, by: str, perishable: str = "perishable", r=r) -> str:
    """All error measures of rows (y, p, perishable), grouped by `by`."""
    group = f"{by}," if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {group} count(*) AS n, {r("sqrt(sum(lg * lg) / count(*))")} AS rmsle,
           {r("sum(abs(er)) / count(*)")} AS mae, {r("sqrt(sum(er * er) / count(*))")} AS rmse,
           {r("sum(CASE WHEN yy > 0 THEN abs(er) / yy END) / nullif(count(*) FILTER (yy > 0), 0) * 100")} AS mape,
           {r("sum(abs(er)) / greatest(sum(yy), 1e-9) * 100")} AS wape,
           {r("sum(wa * abs(er)) / greatest(sum(wa * yy), 1e-9) * 100")} AS wmape,
           {r("1 - sum(er * er) / nullif(sum(yy * yy) - sum(yy) * sum(yy) / count(*), 0)")} AS r2,
           {r("count(*) FILTER (yy = 0) / count(*)")} AS zero_rate,
           {r("sqrt(sum(wl * lg * lg) / sum(wl))")} AS nwrmsle
    FROM (SELECT *, greatest(y, 0) AS yy, greatest(p, 0) - greatest(y, 0) AS er,
                 ln(1 + greatest(p, 0)) - ln(1 + greatest(y, 0)) AS lg,
                 CASE WHEN {perishable} > 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS wa,
                 CASE WHEN {perishable} > 0 THEN CAST(1.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS wl
          FROM {source}) {tail}
    """


ACTUAL_SQL = """
    act AS (SELECT store_nbr, family, date, sum(greatest(unit_sales, 0)) AS y, max(perishable) AS perishable
            FROM v_raw JOIN v_items USING (item_nbr) WHERE date > (SELECT origin FROM v_origin) GROUP BY ALL)
"""


def _actuals(t: RetailTables):
    """Units really sold over the horizon, per series and day with sales."""
    rows = t.later_sales.join(t.items.select("item_nbr", "family", "perishable"), "item_nbr")
    return rows.groupBy(*KEYS).agg(
        F.sum(F.greatest("unit_sales", F.lit(0.0))).alias("target"), F.max("perishable").alias("perishable")
    )


@query(
    "actuals_against_forecast",
    "J13",
    f"""
    WITH {ACTUAL_SQL}
    SELECT store_nbr, family, {d("date")} AS date, {r("y")} AS target, perishable, {r("prediction")} AS prediction
    FROM act JOIN v_family_prediction USING (store_nbr, family, date)
    """,
)
def actuals_against_forecast(t: RetailTables):
    return metrics.actuals_against(t.family_prediction, _actuals(t), KEYS)


@query(
    "forecast_errors",
    "A16",
    f"""
    WITH {ACTUAL_SQL},
    e AS (SELECT family, y, perishable, prediction AS p FROM act JOIN v_family_prediction USING (store_nbr, family, date))
    {score_sql("e", "family")}
    """,
)
def forecast_errors(t: RetailTables):
    both = metrics.actuals_against(t.family_prediction, _actuals(t), KEYS)
    return metrics.evaluate(both, by=["family"], perishable="perishable")


@query(
    "forecast_errors_overall",
    "A16",
    f"""
    WITH {ACTUAL_SQL},
    e AS (SELECT y, perishable, prediction AS p FROM act JOIN v_family_prediction USING (store_nbr, family, date))
    {score_sql("e", "", perishable="0")}
    """,
)
def forecast_errors_overall(t: RetailTables):
    """Without weights, so WMAPE equals WAPE."""
    return metrics.evaluate(metrics.actuals_against(t.family_prediction, _actuals(t), KEYS))


# Two one-shot models over three validation windows of 28 days: the same-weekday mean and
# the four-week level, both from features at least 28 days old.
FOLDS_SQL = f"""
    e28 AS ({_extended_sql(28)}),
    folds AS (
        SELECT store_nbr, family, date, target AS y, perishable, slog_dow_mean4 AS a, slog_roll_mean28 AS b,
               3 - (mx - date) // 28 AS fold, mx - CAST(((mx - date) // 28) * 28 + 27 AS INTEGER) AS val_start,
               mx - CAST(((mx - date) // 28) * 28 AS INTEGER) AS val_end
        FROM e28, (SELECT max(date) AS mx FROM v_panel)
        WHERE (mx - date) // 28 < 3 AND slog_dow_mean4 IS NOT NULL AND slog_roll_mean28 IS NOT NULL)
"""


def fold_predictions(t: RetailTables):
    featured = features.extended_features(t.panel.select(*KEYS, "target", "perishable", "onpromotion"), 28)
    rows = featured.select(
        *KEYS, "target", "perishable", F.col("slog_dow_mean4").alias("a"), F.col("slog_roll_mean28").alias("b")
    )
    return metrics.walk_forward(rows).filter("a IS NOT NULL AND b IS NOT NULL")


def _stored_folds(t: RetailTables):
    return t.stored("fold_predictions", lambda: fold_predictions(t))


@query(
    "validation_folds",
    "W25",
    f"""
    WITH {FOLDS_SQL}
    SELECT CAST(fold AS INTEGER) AS fold, {d("any_value(val_start)")} AS val_start, {d("any_value(val_end)")} AS val_end,
           {d("min(date)")} AS first_day, {d("max(date)")} AS last_day, count(*) AS n_rows, {r("sum(y)")} AS units
    FROM folds GROUP BY fold
    """,
)
def validation_folds(t: RetailTables):
    return _stored_folds(t).groupBy("fold").agg(
        F.first("val_start").alias("val_start"),
        F.first("val_end").alias("val_end"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("target").alias("units"),
    )


@query(
    "sample_weights",
    "W26",
    f"""
    SELECT store_nbr, family, {r("sum(w)")} AS weight, {r("sum(w * CASE WHEN perishable > 0 THEN 1.25 ELSE 1 END)")}
               AS weight_perishable
    FROM (SELECT *, pow(CAST(0.5 AS DOUBLE), greatest((SELECT origin FROM v_origin) - date, 0) / 180) AS w FROM v_panel)
    GROUP BY store_nbr, family
    """,
)
def sample_weights(t: RetailTables):
    return t.panel.groupBy(*SERIES_KEYS).agg(
        F.sum(metrics.sample_weight(t.origin)).alias("weight"),
        F.sum(metrics.sample_weight(t.origin, perishable="perishable")).alias("weight_perishable"),
    )


MODELS_SQL = f"""
    {FOLDS_SQL},
    m AS (SELECT 'weekday' AS model, CAST(fold AS INTEGER) AS fold, y, perishable, exp(a) - 1 AS p FROM folds
          UNION ALL SELECT 'level', CAST(fold AS INTEGER), y, perishable, exp(b) - 1 FROM folds
          UNION ALL SELECT 'blend', CAST(fold AS INTEGER), y, perishable, exp((a + b) / 2) - 1 FROM folds),
    both_levels AS (SELECT * FROM m UNION ALL SELECT model, 0, y, perishable, p FROM m)
"""


def _scores(t: RetailTables):
    rows = _stored_folds(t).select(
        "fold",
        "target",
        "perishable",
        F.expm1("a").alias("weekday"),
        F.expm1("b").alias("level"),
        F.expm1((F.col("a") + F.col("b")) / 2).alias("blend"),
    )
    return metrics.score_models(rows, ["weekday", "level", "blend"], perishable="perishable")


@query(
    "model_scores",
    "A17",
    f"WITH {MODELS_SQL} {score_sql('both_levels', 'model, fold')}",
)
def model_scores(t: RetailTables):
    """Scores per model and fold, and pooled over folds as fold 0."""
    return _scores(t)


@query(
    "model_scores_average",
    "A17",
    f"""
    WITH {MODELS_SQL},
    f AS ({score_sql("m", "model, fold", r="({})".format)})
    SELECT model, {", ".join(f"{r(f'avg({c})')} AS {c}" for c in metrics.METRICS)} FROM f GROUP BY model
    """,
)
def model_scores_average(t: RetailTables):
    return metrics.average_per_fold(_scores(t))


WEEK_SQL = f"""
    {FOLDS_SQL},
    w AS (SELECT *, exp(a) - 1 AS p, (date - val_start) // 7 + 1 AS week FROM folds)
"""


def _weekly(t: RetailTables):
    day = F.datediff("date", "val_start") + 1
    return _stored_folds(t).withColumns({"horizon_day": day, "prediction": F.expm1("a")})


@query(
    "error_by_horizon_week",
    "A18",
    f"""
    WITH {WEEK_SQL}
    SELECT CAST(week AS INTEGER) AS week, count(*) AS n,
           {r("sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + y), 2)))")} AS rmsle
    FROM w GROUP BY week
    """,
)
def error_by_horizon_week(t: RetailTables):
    return metrics.error_by_week(_weekly(t))


@query(
    "family_error_by_week",
    "A18",
    f"""
    WITH {WEEK_SQL},
    e AS (SELECT family, week, sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + y), 2))) AS e FROM w GROUP BY ALL),
    x AS (SELECT family, max(e) FILTER (week = 1) AS w1, max(e) FILTER (week = 2) AS w2,
                 max(e) FILTER (week = 3) AS w3, max(e) FILTER (week = 4) AS w4 FROM e GROUP BY family)
    SELECT family, {r("w1")} AS week_1, {r("w2")} AS week_2, {r("w3")} AS week_3, {r("w4")} AS week_4,
           {r("CASE WHEN w1 > 0 THEN w4 / w1 END")} AS last_over_first
    FROM x
    """,
)
def family_error_by_week(t: RetailTables):
    return metrics.family_week_pivot(_weekly(t), [1, 2, 3, 4])


BLEND_SQL = f"""
    {FOLDS_SQL},
    s AS (SELECT CAST(fold AS INTEGER) AS fold, k / 1e2 AS w, count(*) AS n,
                 sum(pow(greatest(k / 1e2 * a + (1 - k / 1e2) * b, 0) - ln(1 + y), 2)) AS loss
          FROM folds, (SELECT unnest(range(0, 101)) AS k) GROUP BY ALL),
    bw AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fold ORDER BY {r("loss")}, w) = 1),
    pool AS (SELECT w FROM (SELECT w, sum(loss) AS loss FROM s GROUP BY w) ORDER BY {r("loss")}, w LIMIT 1)
"""


def _fold_sums(t: RetailTables):
    return metrics.blend_sums(_stored_folds(t), ["fold"], "target", "a", "b")


@query(
    "blend_weights",
    "M5",
    f"WITH {BLEND_SQL} SELECT fold, n, {r('w')} AS weight, {r('sqrt(loss / n)')} AS rmsle FROM bw",
)
def blend_weights(t: RetailTables):
    return metrics.blend_weights(_stored_folds(t), "target", "a", "b").select("fold", "n", "weight", "rmsle")


@query(
    "blend_weight_choices",
    "M6",
    f"""
    WITH {BLEND_SQL}
    SELECT {r("avg(w)")} AS mean, {r("median(w)")} AS median, {r("max_by(w, fold)")} AS recent,
           {r("(SELECT w FROM pool)")} AS pooled FROM bw
    """,
)
def blend_weight_choices(t: RetailTables):
    weights = metrics.blend_weights(_stored_folds(t), "target", "a", "b")
    return metrics.weight_choices(weights, _fold_sums(t))


@query(
    "honest_blend_scores",
    "M7",
    f"""
    WITH {BLEND_SQL},
    o AS (SELECT s.*, sum(loss) OVER (PARTITION BY w) - loss AS others FROM s),
    best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY {r("others")}, w) = 1)
    SELECT fold, {r("w")} AS weight_others, {r("sqrt(loss / n)")} AS rmsle_honest FROM best
    """,
)
def honest_blend_scores(t: RetailTables):
    return metrics.leave_one_fold_out(_fold_sums(t))


AUDITED = ["slog_lag16", "slog_roll_mean28", "slog_dow_mean4", "days_since_sale", "sales_lag7", "sales_rolling_mean7"]
SERIES_W = "(PARTITION BY store_nbr, family ORDER BY date)"


def _audit_source(view: str) -> str:
    x = _extended_sql(16).replace("FROM v_panel", f"FROM {view}")
    frame = "(PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    return f"""
        SELECT store_nbr, family, date, slog_lag16, slog_roll_mean28, slog_dow_mean4, days_since_sale,
               lag(target, 7) OVER {SERIES_W} AS sales_lag7,
               CASE WHEN count(target) OVER {frame} >= 7 THEN avg(target) OVER {frame} END AS sales_rolling_mean7
        FROM ({x})
    """


@query(
    "leak_audit",
    "M16",
    f"""
    WITH masked AS (SELECT * REPLACE (CASE WHEN date <= (SELECT origin - 16 FROM v_origin) THEN target END AS target)
                    FROM v_panel),
    a AS ({_audit_source("v_panel")}), b AS ({_audit_source("masked")}),
    j AS (SELECT {", ".join(f"avg(CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN 1.0 ELSE 0.0 END) AS {c}" for c in AUDITED)}
          FROM a JOIN b USING (store_nbr, family, date) WHERE date > (SELECT origin - 16 FROM v_origin)),
    u AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS share FROM j" for c in AUDITED)})
    SELECT feature, {r("share")} AS share_changed FROM u WHERE share > 0
    """,
)
def leak_audit(t: RetailTables):
    """Features at a 16-day look-ahead that still read the last 16 days' sales."""
    anchor = F.date_sub(t.origin, 16)

    def build(rows):
        return features.extended_features(features.base_features(rows), 16)

    hidden = t.panel.withColumn("target", F.when(F.col("date") <= anchor, F.col("target")))
    return metrics.leak_audit(build(t.panel), build(hidden), anchor, AUDITED, KEYS)


PARITY = _extended_columns(1)


@query(
    "feature_parity",
    "M17",
    f"""
    WITH recent AS (SELECT * FROM v_panel WHERE date > (SELECT max(date) FROM v_panel) - 60),
    a AS (SELECT * FROM ({_extended_sql(1).replace("FROM v_panel", "FROM recent")})
          WHERE date = (SELECT max(date) FROM v_panel)),
    b AS (SELECT * FROM ({_extended_sql(1)}) WHERE date = (SELECT max(date) FROM v_panel)),
    j AS (SELECT {", ".join(
        f"avg(abs(a.{c} - b.{c})) / coalesce(nullif(avg(abs(b.{c})), 0), 1) AS {c}_r, "
        f"avg(CASE WHEN a.{c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}_n, "
        f"avg(CASE WHEN b.{c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}_m" for c in PARITY)}
          FROM a JOIN b USING (store_nbr, family)),
    u AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c}_r AS rd, {c}_n AS n, {c}_m AS m FROM j" for c in PARITY)})
    SELECT feature, {r("rd")} AS rel_diff, {r("n")} AS null_rate, {r("m")} AS null_rate_other,
           coalesce(rd, 0) > 0.01 OR abs(n - m) > 0.01 AS differs
    FROM u
    """,
)
def feature_parity(t: RetailTables):
    """The last day's features from a 60-day serving window against the full history."""
    last = t.panel.agg(F.max("date")).scalar()
    window = t.panel.filter(F.col("date") > F.date_sub(last, 60))
    served = features.extended_features(window, 1).filter(F.col("date") == last)
    full = features.extended_features(t.panel, 1).filter(F.col("date") == last)
    return metrics.parity_report(served, full, PARITY, SERIES_KEYS)


# ---------------------------------------------------------------- data profile


@query(
    "null_profile",
    "A19",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls FROM v_raw"
        for c in ("date", "store_nbr", "item_nbr", "unit_sales", "onpromotion")
    ),
)
def null_profile(t: RetailTables):
    return metrics.null_counts(t.raw_sales)


DESCRIBED = ["unit_sales", "onpromotion", "class", "perishable"]


@query(
    "value_profile",
    "A19",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
        f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max FROM v_raw JOIN v_items USING (item_nbr)"
        for c in DESCRIBED
    ),
)
def value_profile(t: RetailTables):
    rows = t.raw_sales.join(t.items, "item_nbr")
    return metrics.describe(rows, DESCRIBED)


@query(
    "value_correlations",
    "A19",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(f'corr({a}, {b})')} AS corr FROM v_raw JOIN v_items USING (item_nbr)"
        for i, a in enumerate(DESCRIBED)
        for b in DESCRIBED[i + 1 :]
    ),
)
def value_correlations(t: RetailTables):
    rows = t.raw_sales.join(t.items, "item_nbr")
    return metrics.correlations(rows, DESCRIBED)


@query(
    "mean_sales_by_holiday",
    "A19",
    f"SELECT holiday_type, {r('avg(unit_sales)')} AS mean, count(*) AS n FROM v_family_panel GROUP BY holiday_type",
)
def mean_sales_by_holiday(t: RetailTables):
    return metrics.group_means(t.family_panel, ["holiday_type"], "unit_sales")


@query(
    "mean_sales_by_cluster",
    "A19",
    f"SELECT cluster, family, {r('avg(unit_sales)')} AS mean, count(*) AS n FROM v_family_panel GROUP BY cluster, family",
)
def mean_sales_by_cluster(t: RetailTables):
    return metrics.group_means(t.family_panel, ["cluster", "family"], "unit_sales")


@query(
    "family_by_units",
    "A19",
    f"SELECT family, {r('unit_sales')} AS unit_sales, count(*) AS n FROM v_raw JOIN v_items USING (item_nbr) GROUP BY family, unit_sales",
)
def family_by_units(t: RetailTables):
    return metrics.crosstab(t.raw_sales.join(t.items, "item_nbr"), "family", "unit_sales")


@query(
    "day_outliers",
    "A19",
    f"""
    SELECT {d("date")} AS date, store_nbr, {r("sum(unit_sales)")} AS total, {r("min(unit_sales)")} AS lowest,
           count(*) AS n_rows, {r("sum(unit_sales) - least(min(unit_sales), 0)")} AS total_without
    FROM v_raw GROUP BY date, store_nbr
    """,
)
def day_outliers(t: RetailTables):
    return metrics.day_outliers(t.raw_sales)


@query(
    "rows_per_day",
    "A19",
    f"SELECT {d('date')} AS date, count(*) AS n FROM v_raw GROUP BY date",
)
def rows_per_day(t: RetailTables):
    return t.raw_sales.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
