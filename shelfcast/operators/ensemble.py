"""Global two-model ensemble on `pyspark.ml`: boosted trees and a linear model in log space."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import FEATURE_SPEC_VERSION
from shelfcast.functions.expr import log_target, unlog_target
from shelfcast.operators.features import extended_features, impute
from shelfcast.operators.metrics import best_weight, blend_rmsle, blend_sums, sample_weight

NUMERIC = [
    "slog_roll_mean7",
    "slog_roll_mean14",
    "slog_roll_mean28",
    "slog_dow_mean4",
    "zero_rate_28",
    "days_since_sale",
    "promo_rate_28",
    "dayofweek",
    "dayofmonth",
    "days_to_payday",
    "cluster",
]
CATEGORIES = ["family", "type"]


@dataclass(frozen=True)
class Ensemble:
    trees: list[PipelineModel]
    linear: PipelineModel
    weight: float


def model_rows(featured: DataFrame, min_lag: int) -> DataFrame:
    """Feature rows with nulls filled, label and numeric drivers as doubles."""
    return impute(featured, min_lag).withColumns(
        {"label": log_target("target"), **{c: F.col(c).cast("double") for c in NUMERIC}}
    )


def _stages(regressor) -> Pipeline:
    index = StringIndexer(
        inputCols=CATEGORIES,
        outputCols=[f"{c}_ix" for c in CATEGORIES],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    assemble = VectorAssembler(inputCols=[*NUMERIC, *[f"{c}_ix" for c in CATEGORIES]], outputCol="features")
    return Pipeline(stages=[index, assemble, regressor])


def fit_trees(
    train: DataFrame, seed: int, iterations: int = 10, depth: int = 4, early_stop: str | None = None
) -> PipelineModel:
    """Boosted trees; `early_stop` names a boolean column that marks validation rows."""
    gbt = GBTRegressor(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=iterations,
        maxDepth=depth,
        maxBins=64,
        seed=seed,
        subsamplingRate=0.8,
    )
    if early_stop:
        gbt = gbt.setValidationIndicatorCol(early_stop)
    return _stages(gbt).fit(train)


def fit_linear(train: DataFrame, tweedie: bool = False) -> PipelineModel:
    if tweedie:
        model = GeneralizedLinearRegression(
            featuresCol="features",
            labelCol="label",
            weightCol="weight",
            family="tweedie",
            variancePower=1.5,
            linkPower=0.0,
            regParam=0.1,
        )
    else:
        model = LinearRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.1)
    return _stages(model).fit(train)


def score(df: DataFrame, models: list[PipelineModel], out: str) -> DataFrame:
    """Mean log prediction of several fitted pipelines."""
    helper = {f"{c}_ix" for c in CATEGORIES} | {"features", "prediction"}
    for i, model in enumerate(models):
        df = model.transform(df).withColumn(f"_p{i}", F.col("prediction")).drop(*helper)
    total = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return df.withColumn(out, total).drop(*[f"_p{i}" for i in range(len(models))])


def fit_fold(
    rows: DataFrame,
    train_end: Column,
    val_start: Column,
    val_end: Column,
    seeds: tuple[int, ...] = (7,),
    iterations: int = 10,
) -> DataFrame:
    """Fit both members on days up to `train_end`; validation rows with both log predictions."""
    train = rows.filter(F.col("date") <= train_end).withColumn("weight", sample_weight(train_end))
    val = rows.filter((F.col("date") >= val_start) & (F.col("date") <= val_end))
    trees = [fit_trees(train, s, iterations) for s in seeds]
    linear = fit_linear(train)
    return score(score(val, trees, "tree_log"), [linear], "linear_log")


def blend(df: DataFrame, weight: float | Column, a: str = "tree_log", b: str = "linear_log") -> DataFrame:
    """Blend in log space, then back to units."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return df.withColumn("prediction", unlog_target(w * F.col(a) + (1 - w) * F.col(b)))


def fit_ensemble(rows: DataFrame, last_day: Column, iterations: int = 10, seeds: tuple[int, ...] = (7,)) -> Ensemble:
    """Both members on all rows; the weight comes from the last 28 days held out first.

    The final fit gets 1.1 times the iterations, as it sees more rows.
    """
    start = F.date_sub(last_day, 27)
    fold = fit_fold(rows, F.date_sub(last_day, 28), start, last_day, seeds, iterations)
    weight = blend_sums(fold, [], "target", "tree_log", "linear_log").select(best_weight()).first()[0]
    full = rows.withColumn("weight", sample_weight(last_day))
    trees = [fit_trees(full, s, max(1, int(iterations * 1.1))) for s in seeds]
    return Ensemble(trees, fit_linear(full), float(weight))


def search_trees(
    rows: DataFrame,
    train_end: Column,
    val_end: Column,
    grid: list[dict[str, int]],
    default: dict[str, int],
    gain: float = 0.01,
    parallelism: int = 2,
) -> tuple[dict[str, int], DataFrame]:
    """Try tree settings on one time split; a setting replaces the default only if its blend
    with the linear member is at least `gain` better.

    Each trial is a distributed fit; a few run at once, as in Spark's own tuning.
    """
    train = rows.filter(F.col("date") <= train_end).withColumn("weight", sample_weight(train_end))
    val = rows.filter((F.col("date") > train_end) & (F.col("date") <= val_end))
    linear = fit_linear(train)

    def trial(number: int, params: dict[str, int]) -> tuple:
        scored = score(score(val, [fit_trees(train, 7, **params)], "tree_log"), [linear], "linear_log")
        sums = blend_sums(scored, [], "target", "tree_log", "linear_log")
        fitted = sums.withColumn("w", best_weight()).select("w", blend_rmsle(F.col("w")).alias("e")).first()
        return number, str(params), float(fitted["w"]), float(fitted["e"])

    settings = [default, *grid]
    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(trial, range(len(settings)), settings))
    base = results[0][3]
    best = min(results, key=lambda r: (r[3], r[0]))
    accepted = base > 0 and (base - best[3]) / base >= gain
    report = rows.sparkSession.createDataFrame(results, "trial int, params string, weight double, rmsle double")
    return (settings[best[0]] if accepted else default), report


def forecast_direct(history: DataFrame, future: DataFrame, ensemble: Ensemble, min_lag: int) -> DataFrame:
    """One-shot forecast: features that look back at least `min_lag` days exist for every
    future day, so one transform scores them all."""
    both = history.unionByName(future.withColumn("_future", F.lit(True)), allowMissingColumns=True)
    featured = extended_features(both, min_lag).withColumn("dayofweek", F.weekday("date"))
    ahead = model_rows(featured.filter("_future"), min_lag)
    scored = score(score(ahead, ensemble.trees, "tree_log"), [ensemble.linear], "linear_log")
    return blend(scored, ensemble.weight).select("store_nbr", "family", "date", "prediction")


def save_ensemble(ensemble: Ensemble, path: str, spark) -> None:
    """Members plus one JSON metadata row."""
    for i, tree in enumerate(ensemble.trees):
        tree.write().overwrite().save(f"{path}/trees_{i}")
    ensemble.linear.write().overwrite().save(f"{path}/linear")
    meta = spark.range(1).select(
        F.to_json(
            F.struct(
                F.lit(ensemble.weight).alias("weight"),
                F.lit(len(ensemble.trees)).alias("n_trees"),
                F.lit(FEATURE_SPEC_VERSION).alias("feature_version"),
            )
        ).alias("value")
    )
    meta.write.mode("overwrite").text(f"{path}/meta")


def load_ensemble(path: str, spark) -> Ensemble:
    """Reload and refuse a feature version other than the one this code builds."""
    schema = "weight double, n_trees int, feature_version string"
    meta = spark.read.text(f"{path}/meta").select(F.from_json("value", schema).alias("m")).select("m.*").first()
    if meta["feature_version"] != FEATURE_SPEC_VERSION:
        raise ValueError(f"model built for features {meta['feature_version']}, code has {FEATURE_SPEC_VERSION}")
    trees = [PipelineModel.load(f"{path}/trees_{i}") for i in range(meta["n_trees"])]
    return Ensemble(trees, PipelineModel.load(f"{path}/linear"), meta["weight"])
