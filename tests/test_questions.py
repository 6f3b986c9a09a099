"""Questions by name: parameters, access, and agreement with the all-store answers."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import shelfcast.plans.queries  # noqa: F401  (registers the queries)
from shelfcast.operators.scope import AccessDenied
from shelfcast.plans.questions import CHAIN_WIDE, PLAIN_VALUES, QUESTIONS, VisibleTables, ask
from shelfcast.plans.registry import QUERIES

PARAMS = {
    "demand_multiplier": {"multiplier": 1.5},
    "stockout_loss": {"days": 5},
    "cluster_trend": {"cluster_1": 1, "cluster_2": 2},
    "compare_stores": {"store_1": 1, "store_2": 2},
    "family_forecast": {"family": "promo"},
    "run_scenario": {"demand_multiplier": 1.2, "promo_days": 3},
    "products": {"search": "ring", "sort": "stock"},
}
NEEDS_MORE_STORES = {"cluster_trend", "compare_stores"}


@pytest.mark.parametrize("name", sorted(QUESTIONS))
def test_question_answers_for_all_stores(tables, name):
    got = ask(tables, name, "boss", admin=True, **PARAMS.get(name, {}))
    assert got.limit(1).count() <= 1
    if "store_nbr" in got.columns and name != "dead_stock":
        assert got.select("store_nbr").distinct().count() > 1


@pytest.mark.parametrize("name", sorted(set(QUESTIONS) - NEEDS_MORE_STORES))
def test_manager_sees_only_the_own_store(tables, name):
    got = ask(tables, name, "manager7", **PARAMS.get(name, {}))
    if "store_nbr" in got.columns:
        assert {r[0] for r in got.select("store_nbr").distinct().collect()} <= {7}


@pytest.mark.parametrize("name", sorted(QUESTIONS))
def test_other_store_is_refused(tables, name):
    with pytest.raises(AccessDenied):
        ask(tables, name, "manager7", store_nbr=8, **PARAMS.get(name, {}))


@pytest.mark.parametrize("name", sorted(NEEDS_MORE_STORES))
def test_every_store_of_a_comparison_must_be_visible(tables, name):
    with pytest.raises(AccessDenied):
        ask(tables, name, "manager1", **PARAMS[name])


def test_user_without_stores_is_refused(tables):
    with pytest.raises(AccessDenied):
        ask(tables, "kpi", "nobody")


def test_unknown_question_and_parameters(tables):
    with pytest.raises(KeyError):
        ask(tables, "no_such", "boss", admin=True)
    with pytest.raises(ValueError, match="NO SUCH"):
        ask(tables, "family_forecast", "boss", admin=True, family="NO SUCH")
    with pytest.raises(ValueError, match="out of range"):
        ask(tables, "run_scenario", "boss", admin=True, demand_multiplier=11.0)
    with pytest.raises(ValueError, match="unknown"):
        ask(tables, "run_scenario", "boss", admin=True, weather="rain")


@pytest.mark.parametrize("name", ["stockout_risk", "revenue_bridge", "weekly_pattern", "reorder_point", "inventory_health"])
def test_one_store_equals_its_part_of_the_whole(tables, name):
    one = ask(tables, name, "manager3", store_nbr=3)
    whole = ask(tables, name, "boss", admin=True).filter(F.col("store_nbr") == 3)
    numeric = [c for c, kind in one.dtypes if kind == "double"]
    keys = [c for c in one.columns if c not in numeric]
    a = sorted(one.select(*keys, *[F.round(c, 6) for c in numeric]).collect(), key=str)
    b = sorted(whole.select(*keys, *[F.round(c, 6) for c in numeric]).collect(), key=str)
    assert a == b


@pytest.fixture
def open_tables(spark, tables, tmp_path):
    """Tables of a session of their own, over one root."""
    from shelfcast.plans.serving import RetailTables

    def made(session=None):
        t = RetailTables(session or spark.newSession(), "/root/testdata/sf0.001", root=str(tmp_path))
        for name in ("forecasts", "sku_stats"):
            t.__dict__[name] = getattr(tables, name)
            t.refresh = lambda snapshot=None, t=t, again=t.refresh: (again(snapshot), t.__dict__.update(forecasts=tables.forecasts, sku_stats=tables.sku_stats))[0]
        return t

    return made


def stock_of(t, item_nbr):
    return t.inventory.filter((F.col("store_nbr") == 3) & (F.col("item_nbr") == item_nbr)).first()


def test_restock_is_checked_and_published(spark, open_tables):
    from shelfcast.plans.questions import restock

    t = open_tables()
    one = t.inventory.filter("store_nbr = 3").orderBy("item_nbr").first()
    rows = t.inventory.count()
    schema = "store_nbr int, item_nbr long, quantity double"
    add = spark.createDataFrame([(3, one["item_nbr"], 4.0), (3, one["item_nbr"], 1.0)], schema)
    done = restock(t, add, "manager3", "2001-10-20 08:00:00")
    after = stock_of(t, one["item_nbr"])
    assert after["current_stock"] == one["current_stock"] + 5.0 and after["last_updated"] is not None
    assert done.read("inventory").count() == rows
    with pytest.raises(AccessDenied):
        restock(t, add, "manager4", "2001-10-20")
    with pytest.raises(KeyError):
        restock(t, spark.createDataFrame([(3, -1, 4.0)], schema), "boss", "2001-10-20", admin=True)
    assert t.snapshots.versions() == [1]


def test_restocks_of_two_open_sessions_add_up(spark, open_tables):
    """Both were opened, and had read the stock, before either restocked; an older reader still answers."""
    from shelfcast.plans.questions import restock

    a, b, reader = open_tables(), open_tables(), open_tables()
    item = [t.inventory.filter("store_nbr = 3").orderBy("item_nbr").first() for t in (a, b, reader)][0]
    add = spark.createDataFrame([(3, item["item_nbr"], 100.0)], "store_nbr int, item_nbr long, quantity double")
    restock(a, add, "manager3", "2001-10-20 08:00:00")
    reader.refresh()
    seen = reader.inventory
    assert stock_of(b, item["item_nbr"])["current_stock"] == item["current_stock"]
    restock(b, add, "manager3", "2001-10-20 08:01:00")
    restock(a, add, "manager3", "2001-10-20 08:02:00", token="delivery 4")
    restock(b, add, "manager3", "2001-10-20 08:03:00", token="delivery 4")
    for t in (a, b):
        t.refresh()
        assert stock_of(t, item["item_nbr"])["current_stock"] == item["current_stock"] + 300.0
    for k in range(3):
        restock(a, add, "manager3", f"2001-10-21 08:0{k}:00")
    assert seen.filter((F.col("store_nbr") == 3) & (F.col("item_nbr") == item["item_nbr"])).first()["current_stock"] == item["current_stock"] + 100.0


def test_every_table_is_cut_or_refused(tables):
    """A manager sees no row of another store through any attribute."""
    seen = VisibleTables(tables, "manager7")
    names = [n for n in dir(type(tables)) if not n.startswith("_") and n not in ("served", "stored", "refresh", "snapshots", "snapshot")]
    for name in [*names, "source", "spark", "root"]:
        try:
            value = getattr(seen, name)
        except AccessDenied:
            continue
        if isinstance(value, DataFrame) and "store_nbr" in value.columns:
            assert {r[0] for r in value.select("store_nbr").distinct().collect()} <= {7}, name
        else:
            assert name in CHAIN_WIDE | PLAIN_VALUES, name
    with pytest.raises(AccessDenied):
        _ = seen.source


def test_forecast_window_goes_stale(tables):
    from datetime import timedelta

    last = tables.forecasts.agg(F.max("date")).first()[0]
    fresh = ask(tables, "forecast_window", "boss", admin=True, as_of=last).first()
    old = ask(tables, "forecast_window", "boss", admin=True, as_of=last + timedelta(days=3)).first()
    assert not fresh["is_stale"] and old["is_stale"] and old["days_behind"] == 3


def test_kpi_filters(tables):
    whole = ask(tables, "kpi", "boss", admin=True).first()["total_forecast"]
    parts = [ask(tables, "kpi", "boss", admin=True, family=f[0]).first()["total_forecast"] for f in ask(tables, "families", "boss", admin=True).collect()]
    assert sum(parts) == pytest.approx(whole)


def test_peers_come_from_the_scope(tables):
    got = {r["store_nbr"]: r["peer_count"] for r in ask(tables, "peer_benchmark", "region_asia").collect()}
    want = {r["store_nbr"]: r["peer_count"] for r in QUERIES["peer_benchmark_scoped"].build(tables).collect()}
    assert got == {k: v for k, v in want.items() if k in got}
