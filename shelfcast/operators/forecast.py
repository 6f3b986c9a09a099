"""Forecasting jobs: baselines, per-family models, recursion, routing and the item split.

Model fits never gather a family's rows.  A ridge fit needs only sums of products, which
Spark adds up with partial aggregation; the linear solve then sees one small row per
family.  The day-by-day recursion runs inside one expression per series, over the last
28 days and the horizon, so its memory does not grow with history.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import DAY_BIT, HORIZON_DAYS, NORMAL_DAY, ROUTE_TOLERANCE
from shelfcast.functions.expr import clipped, log_target, unlog_target
from shelfcast.functions.series import SERIES_KEYS, daily_spine, series, trailing
from shelfcast.operators.enrich import with_item_columns
from shelfcast.operators.metrics import evaluate

PAIR = ["store_nbr", "item_nbr"]
# a row id has 6 bits for the day, above those of store and item
MOST_DAYS = 2 ** (63 - DAY_BIT) - 1
HOLDOUT_DAYS = 28
LOOK_BACK = 28
RIDGE = 10.0
MODEL = "family string, n_rows long, ridge double, coef array<double>"

# features a recursion can rebuild from the series itself and known drivers
LOCAL_FEATURES = [
    "one",
    "lag1",
    "lag7",
    "lag14",
    "mean7",
    "mean28",
    "weekday4",
    "promo",
    "weekend",
    "payday",
]


# drivers that a what-if run may change; fitted on what the features above leave unexplained
DRIVER_FEATURES = ["oil", "holiday", "quake", "traffic"]
DRIVER_RIDGE = 10.0


# ---------------------------------------------------------------- plans and baselines


def future_days(last_day: Column, horizon: int = HORIZON_DAYS) -> Column:
    return F.sequence(F.date_add(last_day, 1), F.date_add(last_day, horizon))


def future_series(panel: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Every series of the panel for each day after its last one."""
    last_day = panel.agg(F.max("date")).scalar()
    names = panel.select(*SERIES_KEYS).distinct()
    return daily_spine(names, SERIES_KEYS, F.date_add(last_day, 1), F.date_add(last_day, horizon))


def seasonal_naive(panel: DataFrame, future: DataFrame, weeks: int = 4) -> DataFrame:
    """Mean of the last `weeks` same weekdays known at the forecast origin."""
    last_day = panel.agg(F.max("date")).scalar()
    recent = panel.filter(F.col("date") > F.date_sub(last_day, 7 * weeks))
    by_weekday = recent.groupBy(*SERIES_KEYS, F.weekday("date").alias("_dow")).agg(
        F.avg("target").alias("prediction")
    )
    dated = future.withColumn("_dow", F.weekday("date"))
    out = dated.join(by_weekday, [*SERIES_KEYS, "_dow"], "left").drop("_dow")
    return out.withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def last_week_naive(panel: DataFrame, future: DataFrame) -> DataFrame:
    """The same weekday of the last known week, repeated over the horizon."""
    return seasonal_naive(panel, future, weeks=1)


# ---------------------------------------------------------------- family models


def local_features(panel: DataFrame) -> DataFrame:
    """Training form of `LOCAL_FEATURES` on a completed panel (nulls in the warm-up)."""
    df = panel.withColumns({"y": log_target("target"), "_dow": F.weekday("date")})
    over, y = series(), F.col("y")
    full = {
        "lag1": F.lag(y, 1).over(over),
        "lag7": F.lag(y, 7).over(over),
        "lag14": F.lag(y, 14).over(over),
        "mean7": trailing(y, F.avg, 1, 7, 7, over),
        "mean28": trailing(y, F.avg, 1, 28, 28, over),
        "weekday4": trailing(y, F.avg, 1, 4, 4, series([*SERIES_KEYS, "_dow"])),
    }
    return with_known_drivers(df.withColumns(full)).drop("_dow")


def with_known_drivers(df: DataFrame) -> DataFrame:
    day = F.dayofmonth("date")
    payday = (day == 15) | (day == F.dayofmonth(F.last_day("date")))
    return df.withColumns(
        {
            "one": F.lit(1.0),
            "promo": F.coalesce(F.col("onpromotion").cast("double"), F.lit(0.0)),
            "weekend": F.weekday("date").isin(5, 6).cast("double"),
            "payday": payday.cast("double"),
        }
    )


def complete_rows(features: DataFrame) -> DataFrame:
    return features.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in LOCAL_FEATURES]))


def product_sums(
    rows: DataFrame, by: list[str], weight: Column | None = None, names: list[str] = LOCAL_FEATURES
) -> DataFrame:
    """Sums of feature products per group: all a least-squares fit needs to know."""
    w = F.lit(1.0) if weight is None else weight
    gram = [
        F.sum(w * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]
    ]
    cross = [F.sum(w * F.col(a) * F.col("y")) for a in names]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*gram).alias("gram"), F.array(*cross).alias("cross")
    )


def add_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """Merge product sums of several row sets per group."""
    p = len(LOCAL_FEATURES)

    def total(column: str, size: int) -> Column:
        return F.array(*[F.sum(F.col(column)[i]) for i in range(size)]).alias(column)

    return sums.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), total("gram", p * (p + 1) // 2), total("cross", p)
    )


def _solver(p: int):
    """Batch solver of small ridge systems, drawn towards `prior` where a row has one.

    A nested function travels to the workers by value, so they need numpy and pandas but
    not this package.
    """

    def solve(batches):
        upper = np.triu_indices(p)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                gram = np.zeros((p, p))
                gram[upper] = r.gram
                gram = gram + gram.T - np.diag(np.diag(gram))
                shrink, prior = np.full(p, r.ridge), np.zeros(p)
                if r.prior is None:
                    shrink[0] = 1e-9  # without a prior the intercept is not shrunk
                else:
                    prior = np.asarray(r.prior, dtype=float)
                coef = np.linalg.solve(gram + np.diag(shrink), np.asarray(r.cross, dtype=float) + shrink * prior)
                out.append((r.family, int(r.n_rows), float(r.ridge), coef.tolist()))
            yield pd.DataFrame(out, columns=["family", "n_rows", "ridge", "coef"])

    return solve


def solve_pooled(sums: DataFrame) -> DataFrame:
    """Ridge coefficients over all families together: a row with a null family, none without rows."""
    whole = add_sums(sums, []).filter("n_rows IS NOT NULL").withColumns({"family": F.lit(None).cast("string"), "ridge": F.lit(RIDGE), "prior": F.lit(None).cast("array<double>")})
    return whole.select("family", "n_rows", "ridge", "gram", "cross", "prior").mapInPandas(_solver(len(LOCAL_FEATURES)), MODEL)


def solve_families(sums: DataFrame, ridge: Column | None = None, pooled: DataFrame | None = None) -> DataFrame:
    """Ridge coefficients per family, each drawn towards those of all families together, whose row has a null
    family.

    One rule holds for families of any size: `ridge` counts as so many rows of the pooled model, so a
    family of few rows stays near it.  `ridge` may be a column to try several values, next to `pooled` of
    the untried sums.
    """
    pooled = solve_pooled(sums) if pooled is None else pooled
    prior = pooled.agg(F.first("coef")).scalar()
    ready = sums.filter("family IS NOT NULL").withColumns({"ridge": F.lit(RIDGE) if ridge is None else ridge, "prior": prior})
    own = ready.select("family", "n_rows", "ridge", "gram", "cross", "prior").mapInPandas(_solver(len(LOCAL_FEATURES)), MODEL)
    return own.unionByName(pooled)


def with_coefficients(rows: DataFrame, models: DataFrame, kept: str = "coef", name: str = "used_model") -> DataFrame:
    """Add the coefficients of a row's family, else the pooled ones, and whose they are: local, pooled or zero."""
    own = models.filter("family IS NOT NULL").select("family", F.col("coef").alias("_own"))
    pooled = models.filter("family IS NULL").agg(F.first("coef")).scalar()  # null without a pooled model
    joined = rows.join(own, "family", "left").withColumn("_pooled", pooled)
    route = F.when(F.col("_own").isNotNull(), "local").when(F.col("_pooled").isNotNull(), "pooled").otherwise("zero")
    return joined.withColumns({kept: F.coalesce("_own", "_pooled"), name: route}).drop("_own", "_pooled")


def linear_score(coef: str = "coef") -> Column:
    """Log-space prediction, not below zero sales."""
    terms = [F.col(coef)[i] * F.col(c) for i, c in enumerate(LOCAL_FEATURES)]
    return clipped(reduce(lambda a, b: a + b, terms))


def holdout_split(features: DataFrame, days: int = HOLDOUT_DAYS) -> DataFrame:
    last_day = features.agg(F.max("date")).scalar()
    return features.withColumn("holdout", F.col("date") > F.date_sub(last_day, days))


def train_local(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-family models and their hold-out scores.

    One pass gives the sums of training and hold-out rows; the scored model uses the first,
    the deployed one both.
    """
    rows = holdout_split(complete_rows(local_features(panel)))
    sums = product_sums(rows, ["family", "holdout"])
    trial = solve_families(sums.filter(~F.col("holdout")))
    final = solve_families(add_sums(sums, ["family"]))
    scored = with_coefficients(rows.filter("holdout"), trial).withColumn("prediction", F.expm1(linear_score()))
    return final, evaluate(scored, by=["family"], perishable="perishable")


def driver_values(oil: Column, holiday_type: Column, quake: Column, traffic: Column) -> dict[str, Column]:
    """`DRIVER_FEATURES` of a day."""
    quake = F.coalesce(quake, F.lit(False))
    free = F.coalesce(holiday_type, F.lit(NORMAL_DAY)) != NORMAL_DAY
    return {
        "oil": F.coalesce(oil, F.lit(0.0)) / 100.0,
        "holiday": (free & ~quake).cast("double"),
        "quake": quake.cast("double"),
        "traffic": F.log1p(F.greatest(F.coalesce(traffic.cast("double"), F.lit(0.0)), F.lit(0.0))),
    }


def train_drivers(panel: DataFrame, models: DataFrame) -> DataFrame:
    """Effects of the drivers per family, in log units: a ridge fit of what its model leaves over.

    A driver that never changes in a family's history gets no effect.
    """
    values = driver_values(*[F.col(c) for c in ("oil_price", "holiday_type", "is_earthquake_period", "transactions_lag1")])
    rows = with_coefficients(complete_rows(local_features(panel)), models)
    left = rows.withColumn("y", F.col("y") - linear_score()).withColumns(values)
    names = ["one", *DRIVER_FEATURES]
    sums = product_sums(left, ["family"], names=names).withColumns({"ridge": F.lit(DRIVER_RIDGE), "prior": F.lit(None).cast("array<double>")})
    fitted = sums.select("family", "n_rows", "ridge", "gram", "cross", "prior").mapInPandas(_solver(len(names)), MODEL)
    return fitted.select("family", F.slice("coef", 2, len(DRIVER_FEATURES)).alias("driver_coef"))


def search_ridge(panel: DataFrame, grid: list[float], gain: float = 0.01) -> DataFrame:
    """Best ridge value per family on the hold-out, taken only if it is at least `gain`
    better than the default."""
    rows = holdout_split(complete_rows(local_features(panel)))
    sums = product_sums(rows, ["family", "holdout"]).filter(~F.col("holdout"))
    tried = sums.withColumn("_try", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    pooled = solve_pooled(sums)
    trials = solve_families(tried, F.col("_try"), pooled).filter("family IS NOT NULL").withColumn("trial", F.lit("searched"))
    base = solve_families(sums, pooled=pooled).filter("family IS NOT NULL").withColumn("trial", F.lit("default"))
    models = base.unionByName(trials)
    scored = (
        rows.filter("holdout")
        .join(models, "family")
        .withColumn("prediction", F.expm1(linear_score()))
    )
    errors = evaluate(scored, by=["family", "trial", "ridge"]).select("family", "trial", "ridge", "rmsle")
    best = errors.groupBy("family").agg(
        F.max(F.when(F.col("trial") == "default", F.col("rmsle"))).alias("default_rmsle"),
        F.max(F.when(F.col("trial") == "default", F.col("ridge"))).alias("default_ridge"),
        F.min(F.struct("rmsle", "ridge")).alias("_best"),
    )
    better = (F.col("default_rmsle") - F.col("_best.rmsle")) / F.nullif("default_rmsle", F.lit(0.0))
    accepted = F.coalesce(better >= gain, F.lit(False))
    return best.select(
        "family",
        "default_rmsle",
        F.col("_best.rmsle").alias("best_rmsle"),
        better.alias("improvement"),
        accepted.alias("accepted"),
        F.when(accepted, F.col("_best.ridge")).otherwise(F.col("default_ridge")).alias("ridge"),
    )


# ---------------------------------------------------------------- recursive forecast


def recent_logs(panel: DataFrame) -> DataFrame:
    """The last 28 log sales of each series, oldest first; days before its start are zero."""
    last_day = panel.agg(F.max("date")).scalar()
    recent = panel.filter(F.col("date") > F.date_sub(last_day, LOOK_BACK))
    logs = F.transform(
        F.array_sort(F.collect_list(F.struct("date", log_target("target").alias("y")))), lambda s: s["y"]
    )
    padded = F.concat(F.array_repeat(F.lit(0.0), LOOK_BACK - F.size("_logs")), F.col("_logs"))
    return (
        recent.groupBy(*SERIES_KEYS)
        .agg(logs.alias("_logs"))
        .select(*SERIES_KEYS, padded.cast("array<double>").alias("logs"))
    )


def _next_log(logs: Column, day: Column, coef: Column) -> Column:
    """Prediction for the day after `logs`: the array form of `LOCAL_FEATURES`."""

    def back(k: int) -> Column:
        return F.element_at(logs, -k)

    def mean(k: int) -> Column:
        window = F.slice(logs, F.lit(-k), F.lit(k))
        return F.aggregate(window, F.lit(0.0), lambda s, v: s + v) / k

    weekday = (back(7) + back(14) + back(21) + back(28)) / 4
    values = [
        F.lit(1.0),
        back(1),
        back(7),
        back(14),
        mean(7),
        mean(28),
        weekday,
        day["promo"],
        day["weekend"],
        day["payday"],
    ]
    total = reduce(lambda a, b: a + b, [coef[i] * v for i, v in enumerate(values)])
    return F.greatest(total + day["effect"], F.lit(0.0))


def forecast_recursive(
    panel: DataFrame, future: DataFrame, models: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Forecast day by day, each prediction becoming history for the next.

    `future` has one row per series and day with `onpromotion`, and may have `effect`, log units
    that are added to a day's score; extra `keys` (for example a scenario id) forecast several
    futures of one series.  Every series and day of it comes back: one without history starts from
    zeros, one whose family has no model takes the pooled one (null family), and without that it is zero;
    `used_model` says which.
    """
    keys = keys or SERIES_KEYS
    effect = F.coalesce("effect", F.lit(0.0)) if "effect" in future.columns else F.lit(0.0)
    driver = F.struct("date", "promo", "weekend", "payday", effect.alias("effect"))
    days = (
        with_known_drivers(future)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(driver)).alias("_days"))
    )
    zeros = F.array_repeat(F.lit(0.0), LOOK_BACK)
    joined = days.join(recent_logs(panel), SERIES_KEYS, "left").withColumn("logs", F.coalesce("logs", zeros))
    joined = with_coefficients(joined, models).withColumn("coef", F.coalesce("coef", F.array_repeat(F.lit(0.0), len(LOCAL_FEATURES))))
    grown = F.aggregate(
        "_days",
        F.col("logs"),
        lambda logs, day: F.concat(logs, F.array(F.when(F.col("used_model") == "zero", F.lit(0.0)).otherwise(_next_log(logs, day, F.col("coef"))))),
    )
    ahead = F.slice(grown, F.lit(LOOK_BACK + 1), F.size("_days"))
    pairs = F.arrays_zip(F.transform("_days", lambda d: d["date"]).alias("date"), ahead.alias("log_pred"))
    return (
        joined.select(*keys, "used_model", F.posexplode(pairs).alias("_pos", "_p"))
        .select(
            *keys,
            "used_model",
            F.col("_p.date").alias("date"),
            (F.col("_pos") + 1).alias("horizon_day"),
            unlog_target(F.col("_p.log_pred")).alias("prediction"),
        )
    )


def backtest_recursive(panel: DataFrame, models: DataFrame, origin: Column, days: int) -> DataFrame:
    """Recursive forecast of the `days` days after `origin`, next to what was sold."""
    known = panel.filter(F.col("date") <= origin)
    ahead = panel.filter((F.col("date") > origin) & (F.col("date") <= F.date_add(origin, days)))
    predicted = forecast_recursive(known, ahead.select(*SERIES_KEYS, "date", "onpromotion"), models)
    return predicted.join(
        ahead.select(*SERIES_KEYS, "date", "target", "perishable"), [*SERIES_KEYS, "date"]
    )


# ---------------------------------------------------------------- routing and split


def choose_routes(
    families: DataFrame, scores: DataFrame, reference: DataFrame, tolerance: float = ROUTE_TOLERANCE
) -> DataFrame:
    """Model per family: local while its error is within tolerance, else global, else none.

    `scores` and `reference` carry family and rmsle; a family missing from both gets none.
    """
    local = scores.select("family", F.col("rmsle").alias("local_rmsle"))
    ref = reference.select("family", F.col("rmsle").alias("reference_rmsle"))
    joined = families.select("family").distinct().join(local, "family", "left").join(ref, "family", "left")
    fits = F.col("local_rmsle") <= tolerance * F.coalesce("reference_rmsle", F.lit(float("inf")))
    route = (
        F.when(F.col("local_rmsle").isNotNull() & fits, "local")
        .when(F.col("reference_rmsle").isNotNull(), "global")
        .otherwise("none")
    )
    return joined.withColumn("route", route)


def routed_prediction(df: DataFrame, routes: DataFrame, local: str, global_: str) -> DataFrame:
    """Pick the routed column, clipped at zero, and name the model used."""
    picked = F.when(F.col("route") == "local", F.col(local)).when(F.col("route") == "global", F.col(global_))
    joined = df.join(routes.select("family", "route"), "family", "left")
    return joined.withColumns(
        {
            "prediction": clipped(F.coalesce(picked, F.lit(0.0))),
            "used_model": F.coalesce("route", F.lit("none")),
        }
    ).drop("route")


def split_to_items(
    plan: DataFrame, items: DataFrame, family_forecast: DataFrame, shares: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Family forecast times item share for every planned row; no share means zero.

    Plan rows that carry their family and share already (see `plan_days`) join neither items nor shares, so
    the long side meets only the short forecast of the families.  `keep` names plan columns to pass through.
    """
    keyed = with_shares(with_item_columns(plan, items, "family"), shares)
    family = family_forecast.select("store_nbr", "family", "date", "prediction")
    joined = keyed.join(family, ["store_nbr", "family", "date"], "left")
    units = F.coalesce("prediction", F.lit(0.0)) * F.coalesce("share", F.lit(0.0))
    return joined.select("id", "store_nbr", "item_nbr", "date", clipped(units).alias("predicted_sales"), *keep)


def split_totals(pairs: DataFrame, family_forecast: DataFrame, last_day: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """`split_to_items` of `plan_days(pairs)`, summed over the days of each row of `pairs` (store_nbr, item_nbr,
    family, share): `predicted_sales` and `n_days`, the number of rows in the sum.

    A pair's share is the same on all days, so it multiplies the sum of the days and no pair is spread.  Rows of
    one pair may repeat, as they do in the split.
    """
    p = F.coalesce("prediction", F.lit(0.0))
    ahead = family_forecast.filter(F.col("date").between(F.date_add(last_day, 1), F.date_add(last_day, horizon)))
    sums = ahead.groupBy("store_nbr", "family").agg(
        F.sum(clipped(p)).alias("_up"),
        F.sum(clipped(-p)).alias("_down"),
        (F.count(F.lit(1)) - F.count_distinct("date")).alias("_more"),
    )
    share, zero = F.coalesce("share", F.lit(0.0)), F.lit(0.0)
    units = F.when(share >= 0, share * F.coalesce("_up", zero)).otherwise(-share * F.coalesce("_down", zero))
    days = F.lit(horizon) + F.coalesce("_more", F.lit(0))
    return pairs.join(sums, ["store_nbr", "family"], "left").select(*PAIR, units.alias("predicted_sales"), days.alias("n_days"))


def split_days(
    pairs: DataFrame, family_forecast: DataFrame, last_day: Column, horizon: int = HORIZON_DAYS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """`split_to_items` of `plan_days(pairs)`, summed over the items of each (store, family, *keep) and day.

    All items of a family have its forecast of the day, which multiplies the sum of their shares, so only
    families are spread over the days.
    """
    share = F.coalesce("share", F.lit(0.0))
    groups = pairs.groupBy("store_nbr", "family", *keep).agg(F.sum(clipped(share)).alias("_up"), F.sum(clipped(-share)).alias("_down"))
    family = family_forecast.select("store_nbr", "family", "date", "prediction")
    joined = plan_days(groups, last_day, horizon).join(family, ["store_nbr", "family", "date"], "left")
    p = F.coalesce("prediction", F.lit(0.0))
    units = F.when(p >= 0, p * F.col("_up")).otherwise(-p * F.col("_down"))
    return joined.select("store_nbr", "family", "date", units.alias("predicted_sales"), *keep)


def split_in_order(
    pairs: DataFrame, items: DataFrame, family_forecast: DataFrame, shares: DataFrame, last_day: Column, horizon: int = HORIZON_DAYS, most: int = 1_000_000
) -> DataFrame:
    """`split_to_items` of `plan_days(pairs)` in the order of its ids.

    An id starts with its day, so the rows of a day follow those of the day before, each in the order of the pairs:
    pairs are moved into ranges once and read from there for one day after the other.  The forecast of the
    families is broadcast after it was counted; a longer one leads to a sort of all rows.
    """
    if family_forecast.count() > most:
        return split_to_items(plan_days(pairs, last_day, horizon), items, family_forecast, shares).orderBy("id")
    ranged = with_shares(with_item_columns(pairs, items, "family"), shares).repartitionByRange("pair_id")
    ahead = F.broadcast(family_forecast)
    each = [split_to_items(plan_days(ranged, last_day, horizon, k), items, ahead, shares) for k in range(1, horizon + 1)]
    return reduce(DataFrame.union, [day.sortWithinPartitions("id") for day in each])


def compared_by_pair(planned: DataFrame, made: DataFrame, last_day: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """planned, made, missing and not_planned: the counts of a full join of two sets of (store_nbr, item_nbr, date).

    The days of a pair are counted before they are moved, so a pair meets the other side once.  Days beyond the
    horizon are kept as keys of their own; null keys meet nothing and repeated ones each other, as in a join.
    """
    day = F.datediff("date", last_day)
    within = F.coalesce(day.between(1, horizon), F.lit(False))

    def counted(rows: DataFrame, tag: str) -> DataFrame:
        # one key for all days of the horizon: the first of them
        keyed = rows.select(*PAIR, F.when(within, F.date_add(last_day, 1)).otherwise(F.col("date")).alias("_day"), F.when(within, day).otherwise(0).alias("_d"))
        return keyed.groupBy(*PAIR, "_day").agg(*[F.count_if(F.col("_d") == k).alias(f"{tag}{k}") for k in range(horizon + 1)])

    both = counted(planned, "_p").join(counted(made, "_m"), [*PAIR, "_day"], "full")
    names = ("planned", "made", "missing", "not_planned")

    def of_day(k: int) -> dict[str, Column]:
        p, m = F.coalesce(f"_p{k}", F.lit(0)), F.coalesce(f"_m{k}", F.lit(0))
        one = lambda c, other: F.when(other > 0, c * other).otherwise(c)
        return {"planned": one(p, m), "made": one(m, p), "missing": F.when(m == 0, p).otherwise(0), "not_planned": F.when(p == 0, m).otherwise(0)}

    each = [of_day(k) for k in range(horizon + 1)]
    return both.agg(*[F.coalesce(F.sum(reduce(lambda a, b: a + b, [e[n] for e in each])), F.lit(0)).alias(n) for n in names])


def with_shares(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows with the share of their (store, item); no join when they carry it already."""
    return rows if "share" in rows.columns else rows.join(shares.select(*PAIR, "share"), PAIR, "left")


def batch_score(rows: DataFrame, models: DataFrame, decimals: int = 4) -> DataFrame:
    """Score feature rows with their family's model, else the pooled one, else as zero; rows keep their id."""
    joined = with_coefficients(rows, models).drop("used_model")
    score = F.round(clipped(F.coalesce(F.expm1(linear_score()), F.lit(0.0))), decimals)
    return joined.withColumn("prediction", score).drop("coef")


def number_rows(plan: DataFrame, last_day: Column) -> DataFrame:
    """Row id from the key itself: day of horizon, store and item in separate bit ranges
    (6, 20 and 37 bits), so it is unique without a sort and the same on every run.  Keys that
    don't fit their bits raise."""
    day, store, item = F.datediff("date", last_day).cast("long"), F.col("store_nbr").cast("long"), F.col("item_nbr").cast("long")
    fits = day.between(0, MOST_DAYS) & store.between(0, 2**20 - 1) & item.between(0, 2**37 - 1)
    key = F.shiftleft(day, DAY_BIT) + F.shiftleft(store, 37) + item
    return plan.withColumn("id", F.when(fits, key).otherwise(F.raise_error(F.lit("day, store or item beyond the bits of a row id"))))


def planned_pairs(sold: DataFrame, actual_promotions: DataFrame) -> DataFrame:
    """Every (store, item) of `sold` once, with `promos`: the promotion flags already planned for it, by day.

    The short form of `assortment_plan`, for joins that don't depend on the day; `plan_days` spreads it.
    """
    flags = actual_promotions.filter(F.col("date").isNotNull()).groupBy(*PAIR, "date").agg(
        F.bool_or(F.col("onpromotion").cast("boolean")).alias("onpromotion")
    )
    promos = flags.groupBy(*PAIR).agg(F.map_from_entries(F.collect_list(F.struct("date", "onpromotion"))).alias("promos"))
    return sold.select(*PAIR).distinct().join(promos, PAIR, "left")


def number_pairs(pairs: DataFrame) -> DataFrame:
    """`pair_id`: what `number_rows` gives a pair on day zero.  Keys that don't fit their bits raise."""
    day_zero = F.lit(date(1970, 1, 1))
    return number_rows(pairs.withColumn("date", day_zero), day_zero).drop("date").withColumnRenamed("id", "pair_id")


def plan_days(pairs: DataFrame, last_day: Column, horizon: int = HORIZON_DAYS, only: int | None = None) -> DataFrame:
    """Rows of `pairs` for each day of the horizon, or for the day `only` (from 1), with the planned promotion of the
    day (from `promos`) and the row id of `number_rows` (from `pair_id`), as far as they have them.  Other columns pass
    through."""
    rows = pairs.withColumn("date", F.explode(future_days(last_day, horizon)) if only is None else F.date_add(last_day, only))
    if "promos" in pairs.columns:
        rows = rows.withColumn("onpromotion", F.try_element_at("promos", F.col("date"))).drop("promos")
    if "pair_id" in pairs.columns:
        if horizon > MOST_DAYS:
            raise ValueError(f"a row id has no bits for {horizon} days")
        rows = rows.withColumn("id", F.col("pair_id") + F.shiftleft(F.datediff("date", last_day).cast("long"), DAY_BIT)).drop("pair_id")
    return rows


def plan_families(pairs: DataFrame, last_day: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Planned family days: whether any pair of the family has a promotion planned, and the largest `perishable`.

    Promotions of a pair are bits of the horizon, so pairs are summed to families before days are spread.
    """
    if horizon > MOST_DAYS:
        raise ValueError(f"a number has no bits for {horizon} days")
    bits = F.lit(0).cast("long")
    for k in range(1, horizon + 1):
        bits = bits + F.when(F.try_element_at("promos", F.date_add(last_day, k)), F.lit(1 << k - 1).cast("long")).otherwise(F.lit(0).cast("long"))
    families = pairs.groupBy("store_nbr", "family").agg(F.bit_or(bits).alias("_bits"), F.max("perishable").alias("perishable"))
    days = families.withColumn("date", F.explode(future_days(last_day, horizon)))
    planned = F.getbit("_bits", F.datediff("date", last_day) - 1) == 1
    return days.select("store_nbr", "family", "date", F.lit(0.0).alias("unit_sales"), planned.alias("onpromotion"), "perishable")


def assortment_plan(sold: DataFrame, actual_promotions: DataFrame, last_day: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Future plan: every (store, item) of `sold`, for each day of the horizon, with the promotion already
    planned for that day."""
    rows = plan_days(planned_pairs(sold, actual_promotions), last_day, horizon)
    return rows.select("date", "store_nbr", "item_nbr", "onpromotion")


def last_known_traffic(transactions: DataFrame, future: DataFrame) -> DataFrame:
    """Future store-days with the last known traffic of the store carried forward."""
    last = transactions.groupBy("store_nbr").agg(F.max_by("transactions", "date").alias("transactions_lag1"))
    return future.drop("transactions_lag1").join(last, "store_nbr", "left")
