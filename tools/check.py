"""Run registered queries against their SQL in DuckDB and report differences.

    python tools/check.py [--sf /root/testdata/sf0.01] [--partitions 8] [--cores 8] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfcast.plans import queries as _registered  # noqa: E402,F401
from shelfcast.plans.registry import QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if v is None or (isinstance(v, float) and v != v):
            return "\0null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(float(v))
        return str(v)

    return sorted(tuple(norm(row[i]) for i in order) for row in rows)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--partitions", default="8")
    args.add_argument("--cores", default="8")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = (
        SparkSession.builder.master(f"local[{opts.cores}]")
        .config("spark.sql.shuffle.partitions", opts.partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{opts.sf}/{t}.parquet')")
    bad = 0
    for name, q in QUERIES.items():
        if opts.names and name not in opts.names:
            continue
        try:
            start = time.time()
            df = q.run(spark, opts.sf)
            got = df.collect()
            spark_s = time.time() - start
            if not q.sql:
                print(f"rows  {name:32s} {len(got):7d} rows  spark {spark_s:5.1f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(q.sql)
            want_cols = [c[0] for c in cur.description]
            want = cur.fetchall()
            sql_s = time.time() - start
            a, b = rows_of(df.columns, got), rows_of(want_cols, want)
            ok = sorted(df.columns) == sorted(want_cols) and a == b
            bad += not ok
            print(
                f"{'ok   ' if ok else 'DIFF '} {name:32s} {len(got):7d} rows  spark {spark_s:5.1f}s  sql {sql_s:5.1f}s",
                flush=True,
            )
            if not ok:
                print("   columns", sorted(df.columns), sorted(want_cols))
                print("   counts", len(a), len(b))
                sa, sb = set(a), set(b)
                print("   only spark", sorted(sa - sb)[:3])
                print("   only sql  ", sorted(sb - sa)[:3], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
