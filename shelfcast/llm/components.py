"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): the smallest node it reaches.

    Both steps replace a node's edges by edges to its smallest neighbour; a step moves as many
    rows as there are edges, and hubs are pre-aggregated.  Each round is written to the shared
    folder; it ends when a round changes nothing.
    """
    now = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = stored(large.filter("a != b").distinct(), "large-star")
        # small star: every node points down; its neighbours and itself go to the smallest one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b"))
        before, now = now, stored(small.filter("a != b").distinct(), "small-star")
        release(before, large)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)
