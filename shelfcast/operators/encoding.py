"""Smoothed target encoding by store cluster, fitted on training rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import TARGET_SMOOTHING
from shelfcast.functions.running import exact_median


@dataclass(frozen=True)
class ClusterEncoding:
    """Fitted tables; each has one row per cluster (and family or promotion flag)."""

    by_cluster: DataFrame
    by_family: DataFrame
    by_promotion: DataFrame
    overall: DataFrame

    @staticmethod
    def fit(train: DataFrame, smoothing: float = TARGET_SMOOTHING):
        """Means pulled towards the overall mean by `smoothing` pseudo-rows.

        The median comes from range-partitioned running counts, since the built-in one keeps
        all distinct values of a cluster in one task.
        """
        train = train.withColumn("onpromotion", F.coalesce(F.col("onpromotion").cast("int"), F.lit(0)))
        overall = train.agg(F.avg("target").alias("overall_mean"))
        center = overall.scalar()
        n = F.count("target")

        def smooth(value):
            return (value * n + center * smoothing) / (n + F.lit(smoothing))

        mean = smooth(F.avg("target"))
        stats = [mean.alias("cluster_mean_sales"), F.stddev_samp("target").alias("cluster_std_sales")]
        medians = exact_median(train.select("cluster", "target"), ["cluster"], "target", "_median")
        counts = train.groupBy("cluster").agg(*stats, n.alias("_n")).join(medians, "cluster")
        by_cluster = counts.withColumn(
            "cluster_median_sales",
            (F.col("_median") * F.col("_n") + center * smoothing) / (F.col("_n") + F.lit(smoothing)),
        ).drop("_median", "_n")
        return ClusterEncoding(
            by_cluster,
            train.groupBy("cluster", "family").agg(mean.alias("cluster_family_mean_sales")),
            train.groupBy("cluster", "onpromotion").agg(mean.alias("cluster_promo_mean_sales")),
            overall,
        )

    def apply(self, df: DataFrame) -> DataFrame:
        """Attach the encodings; unseen keys get the overall training mean."""
        flag = F.coalesce(F.col("onpromotion").cast("int"), F.lit(0))
        out = (
            df.withColumn("_flag", flag)
            .join(self.by_cluster, "cluster", "left")
            .join(self.by_family, ["cluster", "family"], "left")
            .join(self.by_promotion.withColumnRenamed("onpromotion", "_flag"), ["cluster", "_flag"], "left")
        )
        out = out.withColumn("cluster_promo_lift", promo_lift())
        encoded = [
            "cluster_mean_sales",
            "cluster_median_sales",
            "cluster_std_sales",
            "cluster_family_mean_sales",
            "cluster_promo_mean_sales",
            "cluster_promo_lift",
        ]
        center = self.overall.scalar()
        return out.withColumns({c: F.coalesce(c, center) for c in encoded}).drop("_flag")


def promo_lift():
    """Promotion mean relative to the cluster mean."""
    return F.col("cluster_promo_mean_sales") / (F.col("cluster_mean_sales") + 1e-8)
