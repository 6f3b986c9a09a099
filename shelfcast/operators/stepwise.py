"""Forecast day by day with any models, over the whole set of lag features.

What a series has behind it is carried from day to day in a small state table, one row a series: its last
`STATE_DAYS` log sales, what was on promotion, and the day of its last sale.  A step joins the drivers of
its day, computes the features of `extended_features` from the state, lets every model score them, takes
the score of the model that the series' family is routed to, and writes the state with this day added.  So
a model may be an expression, a fitted pipeline or anything that adds a column; what a step reads doesn't
grow with history, and a lost executor costs one day at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import DAYS_SINCE_SALE_CAP, LOG_LAGS, LOG_MEAN_WINDOWS
from shelfcast.functions.durable import cut
from shelfcast.functions.expr import log_target, unlog_target
from shelfcast.functions.series import SERIES_KEYS
from shelfcast.operators.enrich import with_calendar

STATE_DAYS = 90
# a model adds its log-space score under the given name
Scorer = Callable[[DataFrame, str], DataFrame]


def initial_state(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, logs, promos (oldest first, of the days a series has) and last_sale at the end of a completed panel."""
    keys = keys or SERIES_KEYS
    last_day = panel.agg(F.max("date")).scalar()
    promo = F.coalesce(F.col("onpromotion").cast("double"), F.lit(0.0)).alias("p")
    day = F.struct("date", log_target("target").alias("y"), promo)
    recent = panel.filter(F.col("date") > F.date_sub(last_day, STATE_DAYS)).groupBy(*keys).agg(F.array_sort(F.collect_list(day)).alias("_d"))
    sold = panel.filter("target > 0").groupBy(*keys).agg(F.max("date").alias("last_sale"))
    held = recent.join(sold, keys, "left")
    return held.select(*keys, F.transform("_d", lambda d: d["y"]).alias("logs"), F.transform("_d", lambda d: d["p"]).alias("promos"), "last_sale")


def _last(values: Column, n: int) -> Column:
    """The last n of an array, or all."""
    return F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, F.lit(n))


def _mean(values: Column, n: int, need: int) -> Column:
    """Mean of the last n, null if fewer than `need` are there."""
    w = _last(values, n)
    return F.when(F.size(w) >= need, F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / F.size(w))


def _std(values: Column, n: int, need: int) -> Column:
    w, mean = _last(values, n), _mean(values, n, 1)
    squares = F.aggregate(F.transform(w, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(w) >= need, F.sqrt(squares / F.nullif(F.size(w) - 1, F.lit(0))))


def _zeros(logs: Column) -> Column:
    return F.transform(logs, lambda y: (y <= 0).cast("double"))


def state_features(rows: DataFrame) -> DataFrame:
    """The features that `extended_features` makes at lag 1, for rows (date, onpromotion, logs, promos, last_sale) of the day
    after the state's last one."""
    logs, promos = F.col("logs"), F.col("promos")
    made = {f"slog_lag{k}": F.when(F.size(logs) >= k, F.get(logs, F.size(logs) - k)) for k in sorted({max(k, 1) for k in LOG_LAGS})}
    made |= {f"slog_roll_mean{w}": _mean(logs, w, max(2, w // 3)) for w in LOG_MEAN_WINDOWS}
    made |= {"slog_roll_std7": _std(logs, 7, 3), "slog_roll_std28": _std(logs, 28, 7)}
    made |= {"zero_rate_7": _mean(_zeros(logs), 7, 2), "zero_rate_28": _mean(_zeros(logs), 28, 7)}
    made |= {"promo_rate_7": _mean(promos, 7, 2), "promo_rate_28": _mean(promos, 28, 7)}
    weekdays = F.filter(F.array(*[F.when(F.size(logs) >= 7 * k, F.get(logs, F.size(logs) - 7 * k)) for k in range(1, 5)]), lambda y: y.isNotNull())
    made["slog_dow_mean4"] = F.when(F.size(weekdays) > 0, F.aggregate(weekdays, F.lit(0.0), lambda a, x: a + x) / F.size(weekdays))
    since = F.coalesce(F.datediff("date", "last_sale"), F.lit(DAYS_SINCE_SALE_CAP))
    made["days_since_sale"] = F.least(since, F.lit(DAYS_SINCE_SALE_CAP))
    rows = rows.withColumns(made)
    more = {"slog_trend_7_28": F.col("slog_roll_mean7") - F.col("slog_roll_mean28"), "slog_ratio_7_28": F.col("slog_roll_mean7") / (F.col("slog_roll_mean28") + 1e-3)}
    return with_calendar(rows.withColumns(more)).withColumn("dayofweek", F.weekday("date"))


def forecast_stepwise(panel: DataFrame, future: DataFrame, models: dict[str, Scorer], routes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, date, horizon_day, prediction and used_model for every row of `future` (keys, date, onpromotion and
    what the models read).

    `routes` (family, route) names the model of each family; a family without one, or with a route that is no model,
    is zero.  A model's null score is zero.  A series without history starts from none.
    """
    keys = keys or SERIES_KEYS
    # days in order: a handful, as the horizon has
    days = [r[0] for r in future.select("date").distinct().orderBy("date").collect()]
    names = future.select(*keys).distinct()
    empty = F.array().cast("array<double>")
    state = names.join(initial_state(panel, keys), keys, "left").join(routes.select("family", "route"), "family", "left")
    state = cut(state.withColumns({"logs": F.coalesce("logs", empty), "promos": F.coalesce("promos", empty)}))
    done: list[DataFrame] = []
    for k, day in enumerate(days, 1):
        # a series may have no row on a day: it goes on as a day without sales that nobody asked for
        ahead = future.filter(F.col("date") == F.lit(day)).withColumn("_asked", F.lit(True))
        rows = state.join(ahead.drop("date"), keys, "left").withColumn("date", F.lit(day))
        scored = state_features(rows)
        for name, model in models.items():
            scored = model(scored, f"_score_{name}")
        picked = [F.when(F.col("route") == name, F.col(f"_score_{name}")) for name in models]
        log_pred = F.greatest(F.coalesce(*picked, F.lit(0.0)), F.lit(0.0)) if picked else F.lit(0.0)
        known = F.col("route").isin(*models) if models else F.lit(False)
        asked = F.coalesce("_asked", F.lit(False))
        promo = F.coalesce(F.col("onpromotion").cast("double"), F.lit(0.0))
        grown = scored.withColumn("_y", F.when(asked, log_pred).otherwise(0.0)).select(
            *keys, "date", "route",
            _last(F.concat("logs", F.array("_y")), STATE_DAYS).alias("logs"),
            _last(F.concat("promos", F.array(promo)), STATE_DAYS).alias("promos"),
            F.when(F.col("_y") > 0, F.col("date")).otherwise(F.col("last_sale")).alias("last_sale"),
            asked.alias("_asked"), F.lit(k).alias("horizon_day"), unlog_target(F.col("_y")).alias("prediction"),
            F.coalesce(F.when(known, F.col("route")), F.lit("zero")).alias("used_model"),
        )
        grown = cut(grown)
        done.append(grown.filter("_asked").select(*keys, "date", "horizon_day", "prediction", "used_model"))
        state = grown.select(*keys, "route", "logs", "promos", "last_sale")
    none = future.select(*keys, "date").limit(0).withColumns({"horizon_day": F.lit(0), "prediction": F.lit(0.0), "used_model": F.lit("zero")})
    return reduce(DataFrame.unionByName, done, none)
