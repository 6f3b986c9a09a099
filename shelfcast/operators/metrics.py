"""Forecast scoring, validation folds, blend weights and feature audits.

Every score is one aggregation over sums, so it needs no sort and no gathered group.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import (
    NWRMSLE_PERISHABLE_WEIGHT,
    RECENCY_HALF_LIFE_DAYS,
    WMAPE_PERISHABLE_WEIGHT,
)
from shelfcast.functions.expr import clipped, grade, require_columns

METRICS = ["rmsle", "mae", "rmse", "mape", "wape", "wmape", "r2", "zero_rate", "nwrmsle"]


def _score_sums(y: Column, yhat: Column, perishable: Column | None) -> list[Column]:
    y, yhat = clipped(y), clipped(yhat)
    err, log_err = yhat - y, F.log1p(yhat) - F.log1p(y)
    fresh = F.lit(False) if perishable is None else F.coalesce(perishable > 0, F.lit(False))
    w_abs = F.when(fresh, WMAPE_PERISHABLE_WEIGHT).otherwise(1.0)
    w_log = F.when(fresh, NWRMSLE_PERISHABLE_WEIGHT).otherwise(1.0)
    return [
        F.count(y).cast("double").alias("n"),
        F.sum(y).alias("s_y"),
        F.sum(y * y).alias("s_yy"),
        F.sum(F.abs(err)).alias("s_abs"),
        F.sum(err * err).alias("s_sq"),
        F.sum(log_err * log_err).alias("s_log"),
        F.sum(F.when(y > 0, F.abs(err) / y)).alias("s_ape"),
        F.count_if(y > 0).alias("n_pos"),
        F.count_if(y == 0).alias("n_zero"),
        F.sum(w_abs * F.abs(err)).alias("s_wabs"),
        F.sum(w_abs * y).alias("s_wy"),
        F.sum(w_log * log_err * log_err).alias("s_wlog"),
        F.sum(w_log).alias("s_w"),
    ]


def _from_sums() -> dict[str, Column]:
    c = F.col
    spread = c("s_yy") - c("s_y") * c("s_y") / c("n")
    tiny = F.lit(1e-9)
    return {
        "rmsle": F.sqrt(c("s_log") / c("n")),
        "mae": c("s_abs") / c("n"),
        "rmse": F.sqrt(c("s_sq") / c("n")),
        "mape": F.when(c("n_pos") > 0, c("s_ape") / c("n_pos") * 100.0),
        "wape": c("s_abs") / F.greatest(c("s_y"), tiny) * 100.0,
        "wmape": c("s_wabs") / F.greatest(c("s_wy"), tiny) * 100.0,
        "r2": F.when(spread > 0, 1 - c("s_sq") / spread),
        "zero_rate": c("n_zero") / c("n"),
        "nwrmsle": F.sqrt(c("s_wlog") / c("s_w")),
    }


def evaluate(
    df: DataFrame,
    y: str = "target",
    yhat: str = "prediction",
    by: list[str] | None = None,
    perishable: str | None = None,
) -> DataFrame:
    """All error measures, overall or per group; negative predictions count as zero.

    Without `perishable` every weight is one, so WMAPE equals WAPE.
    """
    flag = F.col(perishable) if perishable else None
    by = by or []
    sums = df.groupBy(*by).agg(*_score_sums(F.col(y), F.col(yhat), flag))
    return sums.filter("n > 0").select(
        *by, F.col("n").cast("long").alias("n"), *[v.alias(k) for k, v in _from_sums().items()]
    )


def unpivot_models(df: DataFrame, models: list[str]) -> DataFrame:
    """One row per (row, model) with its prediction."""
    keep = [c for c in df.columns if c not in models]
    return df.unpivot(keep, models, "model", "prediction")


def score_models(
    df: DataFrame, models: list[str], y: str = "target", fold: str = "fold", perishable: str | None = None
) -> DataFrame:
    """Scores per (model, fold) and pooled over folds (fold 0).

    Rows are summed per (model, fold) first; the rollup then works on those few sums.
    """
    long = unpivot_models(df, models)
    flag = F.col(perishable) if perishable else None
    sums = long.groupBy("model", fold).agg(*_score_sums(F.col(y), F.col("prediction"), flag))
    names = [c for c in sums.columns if c not in ("model", fold)]
    rolled = sums.rollup("model", fold).agg(
        F.grouping_id().alias("_level"), *[F.sum(c).alias(c) for c in names]
    )
    scored = rolled.filter("_level < 2 AND n > 0").withColumns(_from_sums())
    fold_id = F.when(F.col("_level") == 0, F.col(fold)).otherwise(F.lit(0))
    return scored.select("model", fold_id.alias("fold"), F.col("n").cast("long").alias("n"), *METRICS)


def average_per_fold(scores: DataFrame) -> DataFrame:
    """Plain mean of the fold scores of each model."""
    return scores.filter("fold > 0").groupBy("model").agg(*[F.avg(m).alias(m) for m in METRICS])


def actuals_against(predictions: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have both an actual and a prediction."""
    return actuals.join(predictions, keys)


def horizon_week(day_column: str = "horizon_day") -> Column:
    return (F.floor((F.col(day_column) - 1) / 7) + 1).cast("int")


def error_by_week(df: DataFrame, y: str = "target", yhat: str = "prediction") -> DataFrame:
    """RMSLE per week of the horizon."""
    scored = evaluate(df.withColumn("week", horizon_week()), y, yhat, ["week"])
    return scored.select("week", "n", "rmsle")


def family_week_pivot(df: DataFrame, weeks: list[int], y: str = "target", yhat: str = "prediction") -> DataFrame:
    """RMSLE of each family by horizon week, and last over first week."""
    scored = evaluate(df.withColumn("week", horizon_week()), y, yhat, ["family", "week"])
    wide = scored.groupBy("family").pivot("week", weeks).agg(F.first("rmsle"))
    wide = wide.select("family", *[F.col(str(w)).alias(f"week_{w}") for w in weeks])
    first, last = F.col(f"week_{weeks[0]}"), F.col(f"week_{weeks[-1]}")
    return wide.withColumn("last_over_first", F.when(first > 0, last / first))


# ---------------------------------------------------------------- folds and weights


def fold_bounds(first: date, last: date, n: int = 3, val_days: int = 28, min_train_days: int = 365):
    """Walk-forward folds, oldest first: (fold, train_end, val_start, val_end)."""
    folds = []
    for back in range(n):
        val_end = last - timedelta(days=back * val_days)
        val_start = val_end - timedelta(days=val_days - 1)
        train_end = val_start - timedelta(days=1)
        if (train_end - first).days + 1 < min_train_days:
            break
        folds.append((train_end, val_start, val_end))
    if not folds:
        raise ValueError("no fold leaves enough training days")
    return [(i, *f) for i, f in enumerate(reversed(folds), start=1)]


def walk_forward(df: DataFrame, n: int = 3, val_days: int = 28, min_train_days: int = 365) -> DataFrame:
    """Validation rows with their fold number, newest window last.

    The fold follows from the distance to the last day, so no row is joined or copied;
    training rows of a fold are all rows before its `val_start`.
    """
    bounds = df.agg(F.max("date").alias("hi"), F.min("date").alias("lo"))
    hi = bounds.select("hi").scalar()
    # folds that keep min_train_days days before their validation window
    usable = F.floor((F.datediff("hi", "lo") + 1 - min_train_days) / val_days)
    count = bounds.select(F.least(F.lit(n), usable).cast("int")).scalar()
    back = F.floor(F.datediff(hi, "date") / val_days).cast("int")
    marked = df.withColumn("_back", back).filter(F.col("_back") < count)
    end = F.date_sub(hi, F.col("_back") * val_days)
    return marked.withColumns(
        {
            "fold": (count - F.col("_back")).cast("int"),
            "val_start": F.date_sub(end, val_days - 1),
            "val_end": end,
        }
    ).drop("_back")


def sample_weight(
    ref_date: Column, half_life: float = RECENCY_HALF_LIFE_DAYS, perishable: str | None = None
) -> Column:
    """Weight that halves every `half_life` days of age, heavier for perishables if asked."""
    age = F.greatest(F.datediff(ref_date, "date"), F.lit(0))
    weight = F.pow(F.lit(0.5), age / F.lit(float(half_life)))
    if perishable:
        weight = weight * F.when(F.col(perishable) > 0, NWRMSLE_PERISHABLE_WEIGHT).otherwise(1.0)
    return weight


# ---------------------------------------------------------------- blending


WEIGHT_STEPS = 100  # blend weights are tried in steps of a hundredth, both ends included


def blend_sums(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """Squared log errors of all blends `w a + (1 - w) b`, clipped at zero sales, in one pass.

    `losses` has an entry per weight of the grid; sums of several groups add up by entry.
    """
    truth = F.log1p(clipped(y))

    def loss(k: int) -> Column:
        w = k / WEIGHT_STEPS
        off = F.greatest(F.lit(w) * F.col(a) + F.lit(1 - w) * F.col(b), F.lit(0.0)) - truth
        return F.sum(off * off)

    losses = F.array(*[loss(k) for k in range(WEIGHT_STEPS + 1)])
    return df.groupBy(*by).agg(losses.alias("losses"), F.count(F.lit(1)).alias("n"))


def best_weight(losses: Column | str = "losses") -> Column:
    """Weight of `a` with the smallest loss, the smaller of equal ones.  The grid holds both ends, so
    a blend is never worse than its better member."""
    graded = F.transform(F.col(losses) if isinstance(losses, str) else losses, lambda x: grade(x))
    return (F.array_position(graded, F.array_min(graded)) - 1) / float(WEIGHT_STEPS)


def blend_rmsle(weight: Column) -> Column:
    """Log error of a weight of the grid."""
    return F.sqrt(F.get("losses", F.round(weight * WEIGHT_STEPS).cast("int")) / F.col("n"))


def blend_weights(df: DataFrame, y: str, a: str, b: str, fold: str = "fold") -> DataFrame:
    """Best weight and its error for every fold."""
    sums = blend_sums(df, [fold], y, a, b)
    return sums.withColumn("weight", best_weight()).withColumn("rmsle", blend_rmsle(F.col("weight")))


def _pooled_losses(fold_sums: DataFrame) -> Column:
    return fold_sums.agg(F.array(*[F.sum(F.get("losses", F.lit(k))) for k in range(WEIGHT_STEPS + 1)]).alias("l")).scalar()


def leave_one_fold_out(fold_sums: DataFrame, fold: str = "fold") -> DataFrame:
    """Score each fold with the weight fitted on the other folds.

    `fold_sums` comes from `blend_sums`; the losses of the others are totals less own.
    """
    totalled = fold_sums.withColumn("_all", _pooled_losses(fold_sums))
    others = F.zip_with("_all", "losses", lambda t, own: t - own)
    weighed = totalled.withColumn("weight_others", best_weight(others))
    return weighed.select(fold, "weight_others", blend_rmsle(F.col("weight_others")).alias("rmsle_honest"))


def weight_choices(weights: DataFrame, fold_sums: DataFrame) -> DataFrame:
    """Deployable weights: mean, median and newest of the folds, and the pooled optimum."""
    return weights.agg(
        F.avg("weight").alias("mean"),
        F.median("weight").alias("median"),
        F.max_by("weight", "fold").alias("recent"),
    ).withColumn("_all", _pooled_losses(fold_sums)).withColumn("pooled", best_weight("_all")).drop("_all")


# ---------------------------------------------------------------- audits


def _side_by_side(a: DataFrame, b: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Both builds joined once by key: columns `<feature>_a` and `<feature>_b`."""

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).cast("double").alias(f"{c}_{tag}") for c in features])

    return tagged(a, "a").join(tagged(b, "b"), keys)


def leak_audit(full: DataFrame, masked: DataFrame, anchor: Column, features: list[str], keys: list[str]) -> DataFrame:
    """Features of days after `anchor` that change when those days' targets are hidden.

    Both inputs are the same feature run, once with and once without the later targets.
    """
    features = [c for c in features if c not in keys]
    later = F.col("date") > anchor
    both = _side_by_side(full.filter(later), masked.filter(later), keys, features)
    changed = [
        F.avg((~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).cast("double")).alias(c) for c in features
    ]
    shares = both.agg(*changed).unpivot([], features, "feature", "share_changed")
    return shares.filter(F.col("share_changed") > 0)


def parity_report(
    build: DataFrame, other: DataFrame, features: list[str], keys: list[str], tolerance: float = 0.01
) -> DataFrame:
    """Per feature: mean difference relative to the other build, null rates, flag."""
    both = _side_by_side(build, other, keys, features)

    def entry(c: str) -> Column:
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        size = F.coalesce(F.nullif(F.avg(F.abs(b)), F.lit(0.0)), F.lit(1.0))
        return F.struct(
            F.lit(c).alias("feature"),
            (F.avg(F.abs(a - b)) / size).alias("rel_diff"),
            F.avg(a.isNull().cast("double")).alias("null_rate"),
            F.avg(b.isNull().cast("double")).alias("null_rate_other"),
        )

    report = both.agg(F.array(*[entry(c) for c in features]).alias("r")).select(F.inline("r"))
    apart = (F.coalesce("rel_diff", F.lit(0.0)) > tolerance) | (
        F.abs(F.col("null_rate") - F.col("null_rate_other")) > tolerance
    )
    return report.withColumn("differs", apart)


def missing_features(build: DataFrame, other: DataFrame, features: list[str]) -> dict[str, list[str]]:
    """Features only one of two builds has."""
    return {
        "only_first": [c for c in features if c in build.columns and c not in other.columns],
        "only_second": [c for c in features if c in other.columns and c not in build.columns],
    }


# ---------------------------------------------------------------- data profile


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its null and non-null count."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_n"))
    return wide.unpivot(["_n"], df.columns, "column", "nulls").withColumnRenamed("_n", "n_rows")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of numeric columns in one pass."""
    require_columns(df, columns, "describe")
    stats = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            )
            for c in columns
        ]
    )
    return df.agg(stats.alias("s")).select(F.inline("s"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = F.array(
        *[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(a, b).alias("corr")) for a, b in pairs]
    )
    return df.agg(rows.alias("r")).select(F.inline("r"))


def group_means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of value pairs in long form."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def day_outliers(df: DataFrame, value: str = "unit_sales") -> DataFrame:
    """Day and store totals with and without their single most extreme negative row."""
    low = F.min(value)
    return (
        df.groupBy("date", "store_nbr")
        .agg(F.sum(value).alias("total"), low.alias("lowest"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("total_without", F.col("total") - F.least(F.col("lowest"), F.lit(0.0)))
    )
