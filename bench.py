"""Headline timings: one JSON line on stdout.

Serving tables are built first and timed as one entry, since every question reads them;
each question is then timed to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import shelfcast.plans.queries  # noqa: E402,F401
from shelfcast.plans.registry import QUERIES  # noqa: E402
from shelfcast.plans.serving import tables  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

HEADLINE = [
    # dashboard
    "kpi",
    "daily_forecast",
    "top_products",
    "family_mix",
    "family_trend",
    "product_catalog_page",
    "product_search",
    "restock",
    # fact passes
    "ingest_sales",
    "daily_business_scan",
    "promotion_stats_scan",
    "item_windows",
    "data_errors_removed",
    # questions
    "monthly_revenue",
    "stockout_risk",
    "reorder_profit",
    "inventory_health",
    "store_abc_summary",
    "peer_benchmark",
    "revenue_bridge",
    # features and forecasting
    "complete_panel",
    "base_features",
    "extended_features_lag1",
    "model_scores",
    "recursive_forecast",
    "scenario_runs",
]
# asked again and again by a dashboard: also timed warm, as the 95th percentile of ten calls
DASHBOARD = HEADLINE[:8]
SERVING = [
    "transactions",
    "oil",
    "sold",
    "cube",
    "business",
    "promo_stats",
    "history",
    "family_panel",
    "panel",
    "plan",
    "shares",
    "forecasts",
    "family_forecast",
    "inventory",
    "position",
    "sku_stats",
    "planned_promotions",
    "local_models",
    "future",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = build_session(
        f"local[{cpus}]",
        "shelfcast-bench",
        spark_sql_shuffle_partitions=str(cpus),
        spark_ui_enabled="false",
        spark_driver_memory="8g",
        spark_checkpoint_dir=scratch,
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up

    from shelfcast.operators import aggregates

    times: dict[str, float] = {}
    t = tables(spark, folder)
    start = time.perf_counter()
    t.raw_sales.limit(0).collect()
    times["load_sales"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    for name in SERVING:
        getattr(t, name)
    times["build_serving_tables"] = round(time.perf_counter() - start, 3)

    scans = {
        "daily_business_scan": lambda: aggregates.daily_business(t.family_sales, t.items, t.prices),
        "promotion_stats_scan": lambda: aggregates.promo_family_stats(t.family_sales, t.items),
    }
    for name in HEADLINE:
        start = time.perf_counter()
        drain(scans[name]() if name in scans else QUERIES[name].run(spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    warm: dict[str, float] = {}
    for name in DASHBOARD:
        calls = []
        for _ in range(20):
            start = time.perf_counter()
            drain(QUERIES[name].run(spark, folder))
            calls.append(time.perf_counter() - start)
        warm[name] = round(sorted(calls)[18], 3)  # the 95th of a hundred, among twenty
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "warm_p95": warm,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
