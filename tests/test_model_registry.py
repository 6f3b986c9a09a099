"""A saved model is whole, refuses other inputs, and answers as it did."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.model_registry import ModelMismatch, load_model, save_model
from shelfcast.sources.snapshots import Snapshots


def score(rows, tables, numbers):
    w = tables["weights"].agg(F.sum("w")).scalar()
    return rows.withColumn("prediction", F.col("a") * w + F.col("b") * numbers["slope"])


@pytest.fixture
def saved(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k), k * 0.5) for k in range(50)], "id long, a double, b double")
    log = Snapshots(spark, str(tmp_path))
    weights = spark.createDataFrame([(2.0,), (1.0,)], "w double")
    save_model(log, "m", {"weights": weights}, {"slope": 0.25}, rows, ["a", "b"], ["id"], score, sample=10)
    return log, rows


def test_round_trip(saved):
    log, rows = saved
    tables, numbers = load_model(log, "m", ["a", "b"], score, rows)
    got = score(rows, tables, numbers).agg(F.sum("prediction")).first()[0]
    assert got == pytest.approx(sum(3.0 * k + 0.125 * k for k in range(50))) and log.latest().read("m:sample").count() == 10
    with pytest.raises(KeyError):
        load_model(log, "other", ["a", "b"], score)


def test_other_inputs_are_refused(saved, monkeypatch):
    log, rows = saved
    for features, df in ((["b", "a"], rows), (["a"], rows), (["a", "b"], rows.withColumn("a", F.col("a").cast("float"))), (["a", "c"], rows)):
        with pytest.raises(ModelMismatch):
            load_model(log, "m", features, score, df)
    monkeypatch.setattr("shelfcast.operators.model_registry.FEATURE_SPEC_VERSION", "another")
    with pytest.raises(ModelMismatch):
        load_model(log, "m", ["a", "b"], score, rows)


def test_changed_answers_are_refused(saved, spark):
    log, rows = saved
    with pytest.raises(ModelMismatch, match="answers"):
        load_model(log, "m", ["a", "b"], lambda r, t, n: score(r, t, n).withColumn("prediction", F.col("prediction") + 1e-3), rows)
    log.commit(lambda txn: txn.write("m.weights", spark.createDataFrame([(9.0,)], "w double")))
    with pytest.raises(ModelMismatch, match="answers"):
        load_model(log, "m", ["a", "b"], score, rows)


def test_half_saved_models_are_not_there(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, 1.0, 2.0)], "id long, a double, b double")
    with pytest.raises(ZeroDivisionError):
        save_model(log, "m", {}, {}, rows, ["a", "b"], ["id"], lambda *a: 1 / 0)
    with pytest.raises(KeyError):
        load_model(log, "m", ["a", "b"], score)
