"""Distributed running totals and medians against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.functions.ranking import top_k
from shelfcast.functions.running import exact_median, running_total
from shelfcast.operators.aggregates import abc_classes

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def brute_abc(values: dict[int, float]) -> dict[int, str]:
    total, cum, out = sum(values.values()), 0.0, {}
    for item, v in sorted(values.items(), key=lambda kv: (-kv[1], kv[0])):
        cum += v
        out[item] = "A" if cum <= 0.8 * total else "B" if cum <= 0.95 * total else "C"
    return out


@SLOW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), min_size=1, max_size=60))
def test_running_total_matches_brute_force(spark, rows):
    data = [(g, i, float(v)) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g int, k int, v double")
    got = running_total(df, ["g"], [F.desc("v"), F.col("k")], "v", "cum", slices=5)
    want = {}
    for g in {r[0] for r in data}:
        cum = 0.0
        for _, k, v in sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1])):
            cum += v
            want[k] = cum
    assert {r["k"]: r["cum"] for r in got.collect()} == want


@SLOW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-9, 9)), min_size=1, max_size=50), st.booleans())
def test_exact_median_matches_numpy(spark, rows, upper):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, v double")
    got = {r["g"]: r["m"] for r in exact_median(df, ["g"], "v", "m", upper).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(float(v) for k, v in rows if k == g)
        want = values[len(values) // 2] if upper else float(np.median(values))
        assert got[g] == pytest.approx(want)


def test_hot_group_is_spread_over_slices(spark):
    """One group holds nearly all rows, most of them with the same value."""
    df = spark.range(20000).select(
        F.when(F.col("id") < 19000, 0).otherwise(F.col("id") % 7).alias("g"),
        F.col("id").alias("k"),
        F.when(F.col("id") < 15000, 3.0).otherwise(F.col("id") % 11 + 0.0).alias("v"),
    )
    got = running_total(df, ["g"], [F.desc("v"), F.col("k")], "v", "cum", slices=8)
    ends = got.groupBy("g").agg(F.max("cum").alias("cum"))
    want = df.groupBy("g").agg(F.sum("v").alias("s"))
    assert ends.join(want, "g").filter("cum <> s").isEmpty()
    assert got.count() == 20000


def test_null_group_is_kept_and_totals_are_whole(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), (1, 3, 4.0)], "g int, k int, v double")
    got = {r["k"]: (r["cum"], r["all"]) for r in running_total(df, ["g"], [F.col("k")], "v", "cum", "all").collect()}
    assert got == {1: (2.0, 5.0), 2: (5.0, 5.0), 3: (4.0, 4.0)}


def test_abc_covers_every_item(spark):
    values = {i: float((i * 37) % 50 + 1) for i in range(200)}
    df = spark.createDataFrame(list(values.items()), "item_nbr int, units double")
    got = {r["item_nbr"]: r["abc_class"] for r in abc_classes(df, "units").collect()}
    assert got == brute_abc(values)


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = top_k(df, ["g"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") == 2
