"""Sources, sinks, cleaning and key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions.durable import shared_dir
from shelfcast.functions.expr import finite
from shelfcast.operators import clean
from shelfcast.plans.registry import d, query, r
from shelfcast.plans.serving import RetailTables
from shelfcast.sources import raw, tables


@query(
    "ingest_sales",
    "S2 P1 P2 P4",
    f"""
    SELECT store_nbr, onpromotion, count(*) AS n_rows, {r("sum(unit_sales)")} AS units,
           {d("min(date)")} AS first_day, {d("max(date)")} AS last_day
    FROM v_sales GROUP BY store_nbr, onpromotion
    """,
)
def ingest_sales(t: RetailTables):
    sales = raw.ingest_sales(t.raw_history, start="1995-01-01")
    return sales.groupBy("store_nbr", "onpromotion").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("unit_sales").alias("units"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )


@query(
    "csv_round_trip",
    "S1",
    f"""
    SELECT type, state, count(DISTINCT store_nbr) AS stores, count(*) AS n_rows, {r("sum(unit_sales)")} AS units,
           count(*) FILTER (onpromotion IS NULL) AS unknown_promotion
    FROM v_raw JOIN v_stores USING (store_nbr) GROUP BY type, state
    """,
)
def csv_round_trip(t: RetailTables):
    """The raw file layout: sales and stores written as CSV, then read by the typed scan."""
    folder = f"{t.root}/raw_csv"

    def write(df, name):
        path = f"{folder}/{name}.csv"
        if not tables.path_exists(t.spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").option("header", True).csv(path)

    sales = t.raw_sales.select(
        F.lit(0).cast("long").alias("id"),
        "date",
        "store_nbr",
        "item_nbr",
        "unit_sales",
        F.col("onpromotion").cast("boolean").alias("onpromotion"),
    )
    write(sales, "train")
    write(t.stores, "stores")
    train = raw.read_raw(t.spark, folder, "train").drop("id")
    stores = raw.read_raw(t.spark, folder, "stores")
    return (
        train.join(stores, "store_nbr")
        .groupBy("type", "state")
        .agg(
            F.count_distinct("store_nbr").alias("stores"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("unit_sales").alias("units"),
            F.count_if(F.col("onpromotion").isNull()).alias("unknown_promotion"),
        )
    )


@query(
    "feature_store_reuse",
    "S3",
    f"""
    SELECT family, count(*) AS n_rows, {r("sum(target)")} AS units FROM v_family_panel GROUP BY family
    """,
)
def feature_store_reuse(t: RetailTables):
    """The panel comes back from its parquet table; the build must not run a second time."""
    t.family_panel.limit(0).collect()

    def not_again():
        raise AssertionError("the stored table was rebuilt")

    stored = tables.materialize(t.spark, not_again, f"{t.root}/family_panel")
    return stored.groupBy("family").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("target").alias("units"))


NAMES_SQL = "SELECT item_nbr, upper(name) AS name FROM v_items WHERE family <> 'LARGE'"


def _names(t: RetailTables):
    """A product name source that misses one family."""
    return t.items.filter("family <> 'LARGE'").select("item_nbr", F.upper("name").alias("name"))


@query(
    "catalog_with_names",
    "S4",
    f"""
    WITH n AS ({NAMES_SQL})
    SELECT item_nbr, family, class, perishable, n.name FROM v_items i LEFT JOIN n USING (item_nbr)
    """,
)
def catalog_with_names(t: RetailTables):
    return raw.load_catalog(t.items, _names(t))


@query(
    "name_backfill",
    "S11",
    f"""
    WITH n AS ({NAMES_SQL})
    SELECT item_nbr, family, class, perishable, coalesce(n.name, i.name) AS name
    FROM v_items i LEFT JOIN n USING (item_nbr)
    """,
)
def name_backfill(t: RetailTables):
    return raw.backfill_column(t.items, _names(t))


@query(
    "name_backfill_checks",
    "S11",
    f"""
    WITH n AS ({NAMES_SQL})
    SELECT (SELECT count(*) FROM v_items) AS items,
           (SELECT count(coalesce(n.name, i.name)) FROM v_items i LEFT JOIN n USING (item_nbr)) AS items_named,
           (SELECT count(*) FROM n WHERE name IS NULL) AS source_nulls,
           (SELECT count(name) - count(DISTINCT name) FROM n) AS source_duplicates
    """,
)
def name_backfill_checks(t: RetailTables):
    return raw.backfill_checks(t.items, _names(t))


@query(
    "forecast_load",
    "S5",
    f"""
    SELECT p.id, p.store_nbr, p.item_nbr, {d("p.date")} AS date, {r("f.predicted_sales")} AS predicted_sales
    FROM v_forecasts f JOIN v_plan p USING (id)
    """,
)
def forecast_load(t: RetailTables):
    """No hybrid set exists, so the next candidate is used and completed from the plan."""
    local = t.forecasts.select("id", F.col("predicted_sales").alias("unit_sales"))
    ensemble = local.withColumn("unit_sales", F.lit(-1.0))
    return raw.load_forecasts([None, local, ensemble], t.planned_pairs, t.origin, t.horizon)


@query(
    "transactions_upsert",
    "S6",
    """
    WITH c AS (
        SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store_nbr, l_linestatus AS batch,
               count(DISTINCT l_orderkey) AS n_invoices
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY date, store_nbr ORDER BY batch DESC) AS rn FROM c)
    SELECT store_nbr, strftime(date, '%Y-%m') AS month, batch, count(*) AS days,
           CAST(sum(n_invoices) AS BIGINT) AS n_invoices
    FROM k WHERE rn = 1 GROUP BY ALL
    """,
)
def transactions_upsert(t: RetailTables):
    """Two load batches per store-day; the later batch replaces the earlier one."""
    batches = (
        t.source.lines("l_orderkey", "l_linestatus")
        .groupBy("date", "store_nbr", F.col("l_linestatus").alias("batch"))
        .agg(F.count_distinct("l_orderkey").alias("n_invoices"))
    )
    kept = raw.upsert_latest(batches, ["date", "store_nbr"], [F.desc("batch")])
    return kept.groupBy("store_nbr", F.date_format("date", "yyyy-MM").alias("month"), "batch").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n_invoices").alias("n_invoices")
    )


@query(
    "family_history_export",
    "S7",
    f"SELECT {d('date')} AS date, family, perishable, {r('unit_sales')} AS unit_sales FROM v_history",
)
def family_history_export(t: RetailTables):
    return t.history


@query(
    "family_history_export_compact",
    "S8",
    f"""
    SELECT {d('date')} AS date, family, max(perishable) AS perishable, {r('sum(unit_sales)')} AS unit_sales
    FROM v_history GROUP BY date, family
    """,
)
def family_history_export_compact(t: RetailTables):
    return tables.family_history(t.family_sales, t.items, perishable="max")


@query(
    "prediction_sink",
    "S9",
    f"""
    SELECT count(*) AS n_rows, {r("avg(CASE WHEN predicted_sales > 0 THEN 1.0 ELSE 0.0 END)")} AS nonzero_share
    FROM v_forecasts
    """,
)
def prediction_sink(t: RetailTables):
    """Predictions written as the submission file and reported from it."""
    path = f"{t.root}/predictions_csv"
    if not tables.path_exists(t.spark, f"{path}/_SUCCESS"):
        tables.write_predictions(t.forecasts_in_order, path, ordered=True)
    stored = t.spark.read.schema("id long, predicted_sales double").option("header", True).csv(path)
    return tables.prediction_report(stored)


@query(
    "published_business",
    "S10",
    f"SELECT store_nbr, count(*) AS days, {r('sum(revenue)')} AS revenue FROM v_business GROUP BY store_nbr",
)
def published_business(t: RetailTables):
    tables.publish(t.business, "daily_business_published", f"{shared_dir(t.spark)}/shelfcast-published")
    return t.spark.table("daily_business_published").groupBy("store_nbr").agg(
        F.count(F.lit(1)).alias("days"), F.sum("revenue").alias("revenue")
    )


RESTOCK_SQL = """
    SELECT store_nbr, item_nbr, CAST(lead_time_days AS DOUBLE) AS quantity FROM v_inventory
    WHERE current_stock = 0
    UNION ALL
    SELECT store_nbr, item_nbr, CAST(5 AS DOUBLE) FROM v_inventory WHERE lead_time_days >= 6
    UNION ALL
    SELECT store_nbr + 1000, item_nbr, CAST(1 AS DOUBLE) FROM v_inventory WHERE lead_time_days = 7
"""


def _restocks(t: RetailTables):
    inv = t.inventory
    empty = inv.filter("current_stock = 0").select(
        "store_nbr", "item_nbr", F.col("lead_time_days").cast("double").alias("quantity")
    )
    slow = inv.filter("lead_time_days >= 6").select("store_nbr", "item_nbr", F.lit(5.0).alias("quantity"))
    unknown = inv.filter("lead_time_days = 7").select(
        (F.col("store_nbr") + 1000).alias("store_nbr"), "item_nbr", F.lit(1.0).alias("quantity")
    )
    return empty.unionByName(slow).unionByName(unknown)


@query(
    "restock",
    "S12",
    f"""
    WITH q AS ({RESTOCK_SQL}), a AS (SELECT store_nbr, item_nbr, sum(quantity) AS added FROM q GROUP BY ALL)
    SELECT v.store_nbr, v.item_nbr, {r("current_stock + coalesce(added, 0)")} AS current_stock,
           CASE WHEN added IS NOT NULL THEN '2001-10-19' ELSE 'never' END AS stamped
    FROM v_inventory v LEFT JOIN a USING (store_nbr, item_nbr)
    """,
)
def restock(t: RetailTables):
    done = tables.apply_restock(t.inventory, _restocks(t), "2001-10-19 00:00:00")
    stamped = F.coalesce(F.date_format("last_updated", "yyyy-MM-dd"), F.lit("never"))
    return done.select("store_nbr", "item_nbr", "current_stock", stamped.alias("stamped"))


@query(
    "restock_unknown_keys",
    "S12",
    f"""
    WITH q AS ({RESTOCK_SQL})
    SELECT q.store_nbr, q.item_nbr, {r("quantity")} AS quantity FROM q
    ANTI JOIN v_inventory v ON v.store_nbr = q.store_nbr AND v.item_nbr = q.item_nbr
    """,
)
def restock_unknown_keys(t: RetailTables):
    return tables.unknown_restocks(t.inventory, _restocks(t))


@query(
    "inventory_row",
    "S13",
    f"""
    SELECT store_nbr, item_nbr, {r("current_stock")} AS current_stock, lead_time_days FROM v_inventory
    WHERE store_nbr = 3 AND item_nbr = 39
    """,
)
def inventory_row(t: RetailTables):
    return tables.inventory_row(t.inventory, 3, 39).drop("last_updated")


@query(
    "metadata_round_trip",
    "S14",
    f"""
    SELECT abc_class, count(*) AS n_items, {r("sum(hist_total)")} AS units FROM v_sku GROUP BY abc_class
    """,
)
def metadata_round_trip(t: RetailTables):
    """Class totals stored as JSON text and read back as columns."""
    totals = t.sku_stats.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("hist_total").alias("units")
    )
    meta = tables.to_meta(totals, "class_totals")
    return tables.from_meta(meta, "class_totals", "abc_class string, n_items long, units double")


@query(
    "data_errors_removed",
    "P3",
    """
    SELECT count(*) AS negative_rows,
           count(*) FILTER (abs(unit_sales) > item_max) AS removed_rows
    FROM v_raw_history JOIN (SELECT item_nbr, max(unit_sales) AS item_max FROM v_raw_history GROUP BY 1) m
         USING (item_nbr)
    WHERE unit_sales < 0
    """,
)
def data_errors_removed(t: RetailTables):
    return clean.data_error_count(t.raw_history)


@query(
    "cleaned_sales",
    "P2 P3 P4",
    f"""
    SELECT store_nbr, onpromotion = 1 AS onpromotion, count(*) AS n_rows, {r("sum(unit_sales)")} AS units,
           {r("sum(greatest(unit_sales, 0))")} AS target
    FROM v_clean GROUP BY ALL
    """,
)
def cleaned_sales(t: RetailTables):
    rows = clean.with_target(clean.remove_data_errors(clean.fill_promotion(t.raw_history)))
    return rows.groupBy("store_nbr", "onpromotion").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("unit_sales").alias("units"), F.sum("target").alias("target")
    )


@query("oil_daily", "P5", f"SELECT {d('date')} AS date, {r('oil_price', 4)} AS oil_price FROM v_oil", digits=4)
def oil_daily(t: RetailTables):
    return t.oil


@query(
    "holidays_observed",
    "P6 P7",
    f"""
    SELECT {d("date")} AS date, locale, locale_name, holiday_type, holiday_description,
           lower(holiday_description) LIKE '%terremoto%' AS is_earthquake_period,
           (SELECT count(*) FROM v_sales s WHERE s.date = h.date) AS sales_rows
    FROM v_holidays h
    """,
)
def holidays_observed(t: RetailTables):
    per_day = t.sales.groupBy("date").agg(F.count(F.lit(1)).alias("sales_rows"))
    flagged = clean.with_quake_flag(t.holidays).join(per_day, "date", "left")
    return flagged.withColumn("sales_rows", F.coalesce("sales_rows", F.lit(0)))


@query(
    "panel_gaps",
    "P25 P24",
    """
    SELECT store_nbr, family, count(*) AS n_days, CAST(max(date) - min(date) + 1 AS INTEGER) AS span_days,
           count(*) < (max(date) - min(date) + 1) * 0.95 AS has_gaps
    FROM v_family_panel GROUP BY store_nbr, family
    """,
)
def panel_gaps(t: RetailTables):
    return clean.gap_report(t.family_panel, ["store_nbr", "family"])


@query(
    "observed_days",
    "P26",
    f"""
    SELECT store_nbr, family, count(*) AS days_sold, {r("sum(target)")} AS units
    FROM v_panel WHERE observed GROUP BY store_nbr, family
    """,
)
def observed_days(t: RetailTables):
    return clean.observed_only(t.panel).groupBy("store_nbr", "family").agg(
        F.count(F.lit(1)).alias("days_sold"), F.sum("target").alias("units")
    )


@query(
    "history_and_future",
    "U1",
    f"""
    SELECT store_nbr, family, count(*) AS n_rows, count(observed) AS history_rows,
           count(*) - count(target) AS future_rows, {r("sum(target)")} AS units
    FROM (SELECT store_nbr, family, date, target, observed FROM v_panel
          UNION ALL BY NAME
          SELECT store_nbr, family, date, CAST(NULL AS DOUBLE) AS target FROM v_planned)
    GROUP BY store_nbr, family
    """,
)
def history_and_future(t: RetailTables):
    both = clean.stack(t.panel, t.future)
    return both.groupBy("store_nbr", "family").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("observed").alias("history_rows"),
        F.count_if(F.col("target").isNull()).alias("future_rows"),
        F.sum("target").alias("units"),
    )


@query(
    "first_sale_of_day",
    "U2",
    f"""
    WITH k AS (SELECT date, store_nbr, item_nbr, unit_sales, row_number() OVER (
                   PARTITION BY date, store_nbr ORDER BY item_nbr, unit_sales DESC) AS rn FROM v_sales)
    SELECT store_nbr, count(*) AS days, CAST(sum(item_nbr) AS BIGINT) AS item_sum, {r("sum(unit_sales)")} AS units
    FROM k WHERE rn = 1 GROUP BY store_nbr
    """,
)
def first_sale_of_day(t: RetailTables):
    """One row per store-day in a defined order."""
    kept = raw.upsert_latest(t.sales, ["date", "store_nbr"], [F.col("item_nbr"), F.desc("unit_sales")])
    return kept.groupBy("store_nbr").agg(
        F.count(F.lit(1)).alias("days"), F.sum("item_nbr").alias("item_sum"), F.sum("unit_sales").alias("units")
    )


@query(
    "duplicate_sales_keys",
    "U3",
    f"""
    SELECT {d("date")} AS date, store_nbr, item_nbr, count(*) AS n FROM v_raw_history
    GROUP BY ALL HAVING count(*) > 1
    """,
)
def duplicate_sales_keys(t: RetailTables):
    return clean.duplicate_keys(t.raw_history.select("date", "store_nbr", "item_nbr"), ["date", "store_nbr", "item_nbr"])


@query(
    "finite_lift",
    "P22",
    f"""
    SELECT store_nbr, family, {r("CASE WHEN units_off > 0 THEN units_on / units_off END")} AS ratio
    FROM (SELECT store_nbr, family, sum(CASE WHEN onpromotion = 1 THEN unit_sales ELSE 0 END) AS units_on,
                 sum(CASE WHEN onpromotion = 0 AND date > (SELECT origin FROM v_origin) - 7
                          THEN unit_sales ELSE 0 END) AS units_off
          FROM v_sales JOIN v_items USING (item_nbr) GROUP BY ALL)
    """,
)
def finite_lift(t: RetailTables):
    """Promoted units over last week's other units; infinite and undefined ratios become null."""
    recent = (F.col("onpromotion") == 0) & (F.col("date") > F.date_sub(t.origin, 7))
    sums = (
        t.sales.join(t.items.select("item_nbr", "family"), "item_nbr")
        .groupBy("store_nbr", "family")
        .agg(
            F.sum(F.when(F.col("onpromotion") == 1, F.col("unit_sales")).otherwise(0.0)).alias("on"),
            F.sum(F.when(recent, F.col("unit_sales")).otherwise(0.0)).alias("off"),
        )
    )
    unguarded = F.col("on") / F.when(F.col("off") == 0, F.lit(None)).otherwise(F.col("off"))
    infinite = F.when(F.col("off") == 0, F.lit(float("inf"))).otherwise(unguarded)
    return sums.select("store_nbr", "family", finite(infinite).alias("ratio"))
