"""What the joins of the SimHash operator broadcast: counted tables only, whatever Spark takes their size to be."""

from __future__ import annotations

import random

import pytest

from shelfcast.llm import simhash


@pytest.fixture
def plans(monkeypatch):
    """(tag, plan) of all tables the operator stores."""
    seen, stored = [], simhash.stored

    def noted(df, tag, *rest):
        seen.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, tag, *rest)

    monkeypatch.setattr(simhash, "stored", noted)
    return seen


def test_keys_are_not_broadcast(spark, plans):
    """Each fingerprint has some 85 keys, of which Spark knows nothing when it sizes them."""
    rng = random.Random(4)
    fps = [rng.getrandbits(62) for _ in range(300)]
    pairs = [(fp, fp ^ 1 << rng.randrange(62) ^ 1 << rng.randrange(62)) for fp in fps]
    nodes = simhash.stored(spark.createDataFrame([(fp,) for pair in pairs for fp in pair], "fp long"), "nodes")
    got = {(r["a"], r["b"]) for r in simhash.links(nodes).collect()}
    assert {tuple(sorted(p)) for p in pairs if p[0] != p[1]} <= got
    (plan,) = [plan for tag, plan in plans if tag == "near"]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("crowd", [256, 8])
def test_tables_above_the_count_are_not_broadcast(spark, plans, monkeypatch, crowd):
    """Joins with tables of one row per fingerprint, component or crowded key follow the count, not the bytes of their files."""
    was = simhash.sized
    monkeypatch.setattr(simhash, "sized", lambda table: was(table, 0), raising=False)
    words = [f"w{k}" for k in range(50)]
    rng = random.Random(6)
    base = [rng.choice(words) for _ in range(200)]
    edited = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(60)]
    rows = list(enumerate(edited + [" ".join(rng.sample(words, 9)) for _ in range(40)]))
    assert simhash.near_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).count() == 100
    assert any(tag == "dense" for tag, _ in plans) == (crowd == 8)
    wide = {"near", "dense", "labelled", "of-fp"}
    assert all("BroadcastHashJoin" not in plan for tag, plan in plans if tag in wide)


def test_sized(spark):
    df = simhash.stored(spark.range(20), "few")
    few, many = simhash.sized(df, 20), simhash.sized(df, 19)
    plan = lambda small: df.join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many)
