"""Cutting lineage into storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_STAND_INS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A temporary folder stands in only when Spark itself runs inside this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _STAND_INS:
        _STAND_INS[app] = tempfile.mkdtemp(prefix="shelfcast-")
    return _STAND_INS[app]


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder as parquet and read back: its rows stay fixed afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
