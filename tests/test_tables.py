"""Sources, sinks, access scope and stock questions."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.durable import shared_dir
from shelfcast.functions.expr import check_number, finite, grade
from shelfcast.operators import business, dashboards, enrich, inventory, scope
from shelfcast.plans.serving import RetailTables
from shelfcast.sources import raw, tables as store


def test_materialize_reuses_until_forced(spark, tmp_path):
    path, calls = f"{tmp_path}/t", []

    def build(n):
        calls.append(n)
        return spark.range(n)

    assert store.materialize(spark, lambda: build(3), path).count() == 3
    assert store.materialize(spark, lambda: build(5), path).count() == 3
    assert store.materialize(spark, lambda: build(5), path, force=True).count() == 5
    assert calls == [3, 5]


def test_publish_switches_versions(spark, tmp_path):
    store.publish(spark.range(2), "published_numbers", str(tmp_path))
    old = spark.table("published_numbers")
    store.publish(spark.range(7), "published_numbers", str(tmp_path))
    assert old.count() == 2 and spark.table("published_numbers").count() == 7


def test_raw_csv_is_typed_and_null_promotion_kept(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "train.csv").write_text(
        "id,date,store_nbr,item_nbr,unit_sales,onpromotion\n0,2016-01-01,1,10,-2.5,\n1,2015-12-31,1,11,3,True\n"
    )
    train = raw.read_raw(spark, str(folder), "train")
    assert train.orderBy("id").first()["onpromotion"] is None
    got = raw.ingest_sales(train, "2016-01-01").collect()
    assert [(r["date"], r["unit_sales"], r["onpromotion"]) for r in got] == [(date(2016, 1, 1), 0.0, 0)]


def test_month_layout_prunes_folders(spark, tmp_path):
    rows = [(date(2017, m, 5), m) for m in range(1, 13)]
    raw.store_by_month(spark.createDataFrame(rows, "date date, n int"), f"{tmp_path}/m")
    stored = spark.read.schema("date date, n int, month string").parquet(f"{tmp_path}/m")
    got = raw.between(stored, date(2017, 3, 1), date(2017, 5, 31))
    assert sorted(r["n"] for r in got.collect()) == [3, 4, 5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_forecast_load_takes_first_available(spark):
    plan = spark.createDataFrame([(1, 5, 10, date(2017, 8, 16))], "id long, store_nbr int, item_nbr long, date date")
    some = spark.createDataFrame([(1, 2.0), (9, 1.0)], "id long, unit_sales double")
    got = {r["id"]: r["store_nbr"] for r in raw.load_forecasts([None, some], plan).collect()}
    assert got == {1: 5, 9: None}
    with pytest.raises(ValueError):
        raw.load_forecasts([None, None], plan)


def test_restock_adds_up_and_reports_unknown(spark):
    inv = spark.createDataFrame(
        [(1, 10, 5.0, 3, None), (1, 11, 0.0, 2, None)],
        "store_nbr int, item_nbr long, current_stock double, lead_time_days int, last_updated timestamp",
    )
    add = spark.createDataFrame([(1, 10, 2.0), (1, 10, 3.0), (2, 10, 1.0)], "store_nbr int, item_nbr long, quantity double")
    got = {r["item_nbr"]: r for r in store.apply_restock(inv, add, "2017-08-16 10:00:00").collect()}
    assert got[10]["current_stock"] == 10.0 and got[10]["last_updated"] is not None
    assert got[11]["current_stock"] == 0.0 and got[11]["last_updated"] is None
    assert store.unknown_restocks(inv, add).collect()[0]["store_nbr"] == 2


def test_metadata_round_trip(spark):
    df = spark.createDataFrame([("A", 3, 1.5)], "cls string, n long, v double")
    back = store.from_meta(store.to_meta(df, "k"), "k", "cls string, n long, v double")
    assert back.collect() == df.collect()


class _Session:
    """The two things `shared_dir` asks a session for."""

    def __init__(self, master, named=None):
        self.conf = self
        self.named = named
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named or default


def test_shared_folder_comes_from_the_session():
    assert shared_dir(_Session("spark://host:7077", "hdfs:///ckpt")) == "hdfs:///ckpt"
    with pytest.raises(RuntimeError):
        shared_dir(_Session("spark://host:7077"))
    assert shared_dir(_Session("local[2]")) == shared_dir(_Session("local[2]"))


def test_forced_tables_are_rebuilt(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    first = RetailTables(spark, folder, root=str(tmp_path))
    n = first.stored("numbers", lambda: spark.range(3)).count()
    again = RetailTables(spark, folder, root=str(tmp_path))
    forced = RetailTables(spark, folder, root=str(tmp_path), force=True)
    assert n == again.stored("numbers", lambda: spark.range(9)).count() == 3
    assert forced.stored("numbers", lambda: spark.range(9)).count() == 9


# ---------------------------------------------------------------- access


@pytest.fixture(scope="module")
def access(spark):
    return spark.createDataFrame([("m1", 1), ("m2", 2), ("pair", 1), ("pair", 2)], "username string, store_nbr int")


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "store_nbr int, v double")


def stores_of(df):
    return sorted(r["store_nbr"] for r in df.collect())


def test_scope_filters_by_user(access, facts):
    assert stores_of(scope.scope(facts, access, "m1")) == [1]
    assert stores_of(scope.scope(facts, access, "pair")) == [1, 2]
    assert stores_of(scope.scope(facts, access, "boss", admin=True)) == [1, 2, 3]


def test_empty_scope_is_refused_not_unfiltered(access, facts):
    with pytest.raises(scope.AccessDenied):
        scope.scope(facts, access, "nobody")


def test_store_outside_scope_is_refused(access, facts):
    assert stores_of(scope.scope(facts, access, "pair", store_nbr=2)) == [2]
    with pytest.raises(scope.AccessDenied):
        scope.scope(facts, access, "m1", store_nbr=2)


def test_every_involved_store_must_be_visible(access, facts):
    scope.check_stores(facts.filter("store_nbr < 3"), access, "pair")
    scope.check_stores(facts, access, "boss", admin=True)
    with pytest.raises(scope.AccessDenied):
        scope.check_stores(facts, access, "pair")


# ---------------------------------------------------------------- search and pages


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, f"name {i}", "GROCERY I" if i % 2 else "DELI", i, i % 2) for i in range(1, 46)] + [(99, None, "O'NEIL %_", 1, 0)]
    return spark.createDataFrame(rows, "item_nbr long, name string, family string, class int, perishable int")


@pytest.mark.parametrize(
    "needle",
    ["' OR '1'='1", "'; DROP TABLE items; --", "\" OR \"\"=\"", "1' UNION SELECT 1--", "\\", "%%%", "[a-z]*", "(", "*", "?", "\u0000", "name'"],
)
def test_search_takes_text_literally(items, needle):
    assert dashboards.search_products(items, needle).isEmpty()


def test_search_finds_in_any_case_and_in_numbers(items):
    assert dashboards.search_products(items, " grocery ").count() == 23
    assert {r["item_nbr"] for r in dashboards.search_products(items, "45").collect()} == {45}
    assert dashboards.search_products(items, "o'neil %_").count() == 1
    assert dashboards.search_products(items, "O'NEIL %X").count() == 0


def test_pages_partition_the_catalogue(spark, items):
    inv = spark.createDataFrame([(1, i, float(i % 5)) for i in range(1, 46)], "store_nbr int, item_nbr long, current_stock double")
    sold = spark.createDataFrame([(1, i, float(i % 3)) for i in range(1, 46)], "store_nbr int, item_nbr long, unit_sales double")
    rows = dashboards.catalog(items, inv, sold)
    pages = [[r["item_nbr"] for r in dashboards.catalog_page(rows, p, 20).collect()] for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 6, 0]
    assert len({i for p in pages for i in p}) == 46
    assert dashboards.catalog_counts(rows, 20).first().asDict() == {"total": 46, "total_pages": 3}


@pytest.mark.parametrize("sort,descending", [("stock", True), ("stock", False), ("name", False), ("item", True)])
def test_pages_by_cursor_are_pages_by_offset(spark, sort, descending):
    """Whole values that tie across pages, names that are missing; every page by its cursor alone."""
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else f"n{k % 7}", float(k % 4), float(k)) for k in range(57)], "item_nbr long, name string, stock double, sold double")
    cursors = {r["page"]: (r["value"], r["item_nbr"]) for r in dashboards.page_cursors(rows, 10, sort, descending).collect()}
    assert sorted(cursors) == [2, 3, 4, 5, 6]
    for page in range(1, 8):
        want = [r["item_nbr"] for r in dashboards.catalog_page(rows, page, 10, sort=sort, descending=descending).collect()]
        if page <= 6:
            after = dashboards.page_after(rows, cursors.get(page), 10, sort=sort, descending=descending)
            assert [r["item_nbr"] for r in after.collect()] == want
            plan = after._jdf.queryExecution().executedPlan().toString()
            assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert dashboards.page_cursors(rows.limit(0), 10).count() == 0 and dashboards.page_cursors(rows, 57).count() == 0


@pytest.mark.parametrize("page,size", [(0, 20), (-5, 20), (1, 0)])
def test_bad_pages_are_refused(items, page, size):
    with pytest.raises(ValueError):
        dashboards.catalog_page(items.withColumn("sold", F.lit(0.0)), page, size)


# ---------------------------------------------------------------- stock arithmetic


def test_reorder_point_by_hand(spark):
    rows = [(1, 10, 32.0, 2.0, 4.0, 4), (1, 11, 32.0, 2.0, 100.0, None)]
    pos = spark.createDataFrame(rows, "store_nbr int, item_nbr long, forecast double, daily_demand double, current_stock double, lead_time_days int")
    got = {r["item_nbr"]: r for r in inventory.reorder_point(pos).collect()}
    safety = 1.65 * 0.2 * 2.0 * 2.0
    assert got[10]["safety_stock"] == pytest.approx(safety)
    assert got[10]["reorder_point"] == pytest.approx(8 + safety) and got[10]["need_reorder"]
    assert got[11]["lead_time_used"] == 3.0 and not got[11]["need_reorder"]


def test_risk_reports_true_count_beyond_the_list(spark):
    rows = [(1, i, 10.0 + i, 1.0, 5.0, 2) for i in range(25)]
    pos = spark.createDataFrame(rows, "store_nbr int, item_nbr long, forecast double, daily_demand double, current_stock double, lead_time_days int")
    got = inventory.stockout_risk(pos).collect()
    assert len(got) == 10 and {r["risk_items"] for r in got} == {25}
    assert got and max(r["deficit"] for r in got) == 29.0


@pytest.mark.parametrize("bad", [-1, float("nan"), float("inf"), "x"])
def test_bad_parameters_are_refused(spark, bad):
    with pytest.raises(ValueError):
        check_number(bad, "multiplier")


def test_finite_and_grade(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.25,), (None,)], "v double")
    assert [r[0] for r in df.select(finite("v")).collect()] == [None, None, 1.25, None]
    noisy = spark.createDataFrame([(0.1 + 0.2,), (0.3,), (-1.0000000001,), (5e12 + 0.25,)], "v double")
    a, b, c, big = [r[0] for r in noisy.select(grade("v")).collect()]
    assert a == b and c == -1.0 and big == 5e12 + 0.25


def test_unknown_family_gets_default_price(spark):
    prices = spark.createDataFrame([("DELI", 3.6, 0.80, 0.02), ("EGGS", 2.0, 0.82, 0.03)], "family string, unit_price double, cost_ratio double, return_rate double")
    df = spark.createDataFrame([("deli",), ("NO SUCH",), (None,)], "family string")
    got = [(r["unit_price"], r["cost_ratio"]) for r in enrich.join_prices(df, prices).orderBy("family").collect()]
    assert sorted(got) == sorted([(1.8, 0.78), (1.8, 0.78), (3.6, 0.80)])


def test_traffic_windows_have_equal_length(spark):
    rows = [(date(2017, 8, d), 1, 10 if d > 8 else 5) for d in range(1, 17)]
    tx = spark.createDataFrame(rows, "date date, store_nbr int, n_invoices int")
    got = business.store_traffic(tx, 8).first()
    assert (got["invoices_now"], got["invoices_before"], got["trend_pct"]) == (80, 40, 100.0)
    halved = business.store_traffic(tx, 10).first()
    assert halved["active_days_now"] == halved["active_days_before"] == 5
