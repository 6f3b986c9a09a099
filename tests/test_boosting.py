"""Grouped boosting against one tree grown by trying every split, and by plain prediction."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators.boosting import Plan, cut_points, fit_boosted, with_tree_score

FEATURES = ["a", "b", "c"]
SCHEMA = "g string, a double, b double, c double, y double, w double"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for k in range(1500):
        g = rng.choice(["x", "y", "y", "y", None]) if k > 4 else "tiny"
        a, b, c = rng.random(), float(rng.randrange(6)), rng.gauss(0, 1)
        y = (2.0 if a > 0.4 else 0.0) + (b if g == "y" else -b) * 0.5 + rng.gauss(0, 0.1)
        rows.append((g, a, b if rng.random() > 0.02 else None, c, y, rng.choice([1.0, 2.0])))
    return rows


def grown(rows, cuts, plan, rest):
    """One tree by trying all splits: a function of a row's features."""

    def value(part):
        return plan.rate * sum(w * r for *_, w, r in part) / (sum(w for *_, w, _ in part) + plan.shrink)

    def part_gain(part):
        return sum(w * r for *_, w, r in part) ** 2 / (sum(w for *_, w, _ in part) + plan.shrink)

    def above(v, c):
        return v is not None and v > c

    def node(part, depth):
        if depth == 0:
            v = value(part)
            return lambda x: v
        best = (1e-12, None)
        for f in range(3):
            for c in cuts[f]:
                left, right = [p for p in part if not above(p[f], c)], [p for p in part if above(p[f], c)]
                if min(sum(w for *_, w, _ in side) for side in (left, right)) < plan.least_rows:
                    continue
                gain = part_gain(left) + part_gain(right) - part_gain(part)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, c, left, right))
        if best[1] is None:
            return node(part, depth - 1)
        f, c, left, right = best[1]
        low, high = node(left, depth - 1), node(right, depth - 1)
        return lambda x: high(x) if above(x[f], c) else low(x)

    return node([(a, b, c, w, r) for (_, a, b, c, _, w), r in zip(rows, rest, strict=True)], plan.depth)


def test_trees_are_the_best_ones(spark, data):
    plan = Plan(pooled_rounds=2, group_rounds=2, depth=2, bins=8, rate=0.5, shrink=3.0, least_rows=5.0)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    cuts = cut_points(df, FEATURES, plan.bins)
    models = fit_boosted(df, "g", FEATURES, "y", plan, "w", cuts)
    got = {(r["g"], r["a"], r["b"], r["c"]): r["p"] for r in with_tree_score(df, models, "g", FEATURES, "p", plan.depth).collect()}
    base = sum(r[4] * r[5] for r in data) / sum(r[5] for r in data)
    p = np.full(len(data), base)
    for _ in range(2):
        tree = grown(data, cuts, plan, [r[4] - q for r, q in zip(data, p, strict=True)])
        p += [tree(r[1:4]) for r in data]
    for g in {r[0] for r in data} - {None}:
        at = [k for k, r in enumerate(data) if r[0] == g]
        for _ in range(2):
            own = [data[k] for k in at]
            tree = grown(own, cuts, plan, [data[k][4] - p[k] for k in at])
            p[at] += [tree(r[1:4]) for r in own]
    assert [got[r[:4]] for r in data] == pytest.approx(p.tolist())


def test_groups_of_any_size_have_a_model(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    models = fit_boosted(df, "g", FEATURES, "y", Plan(pooled_rounds=4, group_rounds=4))
    assert {r["g"] for r in models.select("g").collect()} == {"x", "y", "tiny", None}
    scored = with_tree_score(df, models, "g", FEATURES, "p").filter("g in ('x', 'y')")
    error = scored.groupBy("g").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("e"), F.variance("y").alias("v")).collect()
    assert all(r["e"] < 0.35 * r["v"] for r in error)
    # five rows move their group's model a little way from the pooled one
    away = with_tree_score(df.filter("g = 'tiny'").withColumn("other", F.lit("unseen")), models, "g", FEATURES, "own")
    away = with_tree_score(away.drop("g").withColumnRenamed("other", "g"), models, "g", FEATURES, "pooled")
    assert away.filter("abs(own - pooled) > 1.0").isEmpty()


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    models = fit_boosted(empty, "g", FEATURES, "y", cuts=[[0.5], [1.0], [0.0]])
    row = spark.createDataFrame([("q", 1.0, None, 2.0, None, 1.0)], SCHEMA)
    assert with_tree_score(row, models, "g", FEATURES, "p").first()["p"] == 0.0
    constant = spark.createDataFrame([("q", 1.0, 1.0, 1.0, 4.0, 1.0)] * 50, SCHEMA)
    models = fit_boosted(constant, "g", FEATURES, "y")
    assert with_tree_score(constant, models, "g", FEATURES, "p").first()["p"] == pytest.approx(4.0)
