"""Reading, writing and publishing derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.enrich import with_item_columns
from shelfcast.sources.snapshots import Snapshots


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _file_system(spark, path)
    return fs.exists(hadoop_path)


def newest_partition(spark: SparkSession, path: str, key: str) -> str:
    """Largest value of a partition folder, from one listing and no data."""
    hadoop_path, fs = _file_system(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    return max(n.split("=", 1)[1] for n in names if n.startswith(f"{key}=") and "__HIVE" not in n)


def materialize(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    path: str,
    force: bool = False,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Reuse the parquet table at `path`; build it when it is absent or `force` is set.

    `_SUCCESS` decides, so a half-written table counts as absent.
    """
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        writer = build().write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


def publish(df: DataFrame, name: str, root: str) -> str:
    """Commit a new state of a table to the log at `root`, and point the view `name` of this session at it.

    Readers of any session see the old state until the commit, and the new one when they look again.
    """
    done = Snapshots(df.sparkSession, root).commit(lambda txn: txn.write(name, df))
    done.read(name).createOrReplaceTempView(name)
    return done.path(name)


def family_history(sales: DataFrame, items: DataFrame, perishable: str = "group") -> DataFrame:
    """Units by day and family: perishable as a grouping key, or its maximum."""
    joined = with_item_columns(sales, items, "family", "perishable").filter(F.col("family").isNotNull())
    if perishable == "group":
        return joined.groupBy("date", "family", "perishable").agg(F.sum("unit_sales").alias("unit_sales"))
    return joined.groupBy("date", "family").agg(
        F.max("perishable").alias("perishable"), F.sum("unit_sales").alias("unit_sales")
    )


def export_family_history(history: DataFrame, path: str, decimals: int = 2) -> None:
    """CSV export in reading order: day, then units from large to small."""
    (
        history.withColumn("unit_sales", F.round("unit_sales", decimals))
        .orderBy("date", F.desc("unit_sales"), "family")
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def prediction_rows(predictions: DataFrame) -> DataFrame:
    return predictions.select("id", F.col("predicted_sales").alias("unit_sales"))


def write_predictions(predictions: DataFrame, path: str, ordered: bool = False) -> None:
    """Prediction file `id, unit_sales` in id order; `ordered` rows come in it and aren't sorted again."""
    rows = prediction_rows(predictions)
    (rows if ordered else rows.orderBy("id")).write.mode("overwrite").option("header", True).csv(path)


def prediction_report(predictions: DataFrame) -> DataFrame:
    """Row count and share of non-zero predictions."""
    return predictions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col("predicted_sales") > 0).cast("double")).alias("nonzero_share"),
    )


def to_meta(df: DataFrame, key: str) -> DataFrame:
    """Key/value rows whose value is the JSON text of all columns."""
    return df.select(F.lit(key).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def from_meta(meta: DataFrame, key: str, schema: str) -> DataFrame:
    """Columns of a JSON metadata row."""
    parsed = meta.filter(F.col("key") == key).select(F.from_json("value", schema).alias("v"))
    return parsed.select("v.*")


def apply_restock(inventory: DataFrame, restocks: DataFrame, at: str) -> DataFrame:
    """Add restock quantities to stock and stamp the rows that changed.

    Several restocks of one item add up; see `unknown_restocks` for keys not in stock.
    """
    added = restocks.groupBy("store_nbr", "item_nbr").agg(F.sum("quantity").alias("_added"))
    return (
        inventory.join(added, ["store_nbr", "item_nbr"], "left")
        .withColumn("current_stock", F.col("current_stock") + F.coalesce("_added", F.lit(0.0)))
        .withColumn(
            "last_updated",
            F.when(F.col("_added").isNotNull(), F.lit(at).cast("timestamp")).otherwise(F.col("last_updated")),
        )
        .drop("_added")
    )


def unknown_restocks(inventory: DataFrame, restocks: DataFrame) -> DataFrame:
    """Restock rows whose (store, item) is not managed: each is an error for the caller."""
    return restocks.join(inventory.select("store_nbr", "item_nbr"), ["store_nbr", "item_nbr"], "left_anti")


def inventory_row(inventory: DataFrame, store_nbr: int, item_nbr: int) -> DataFrame:
    return inventory.filter((F.col("store_nbr") == store_nbr) & (F.col("item_nbr") == item_nbr))
