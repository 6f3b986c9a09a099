"""Running totals and exact quantiles for groups of any size.

A window over a whole group puts that group into one task.  Here rows are range
partitioned by (group, order), summed inside each partition, and shifted by the totals
of the partitions before it; only one row per (group, partition) is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.durable import cut


def running_total(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    value: str,
    out: str,
    total: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add `out`: the sum of `value` up to and including the row, in `order`, per group, and
    `total`, if named: the sum over the group.

    `order` must be unique inside a group; a null group is a group.  Runs one job: the range
    cut is written to the checkpoint folder so that both uses below see the same partitions.
    """
    by = [*[F.col(g) for g in group], *order]
    # without a number, adaptive execution merges small neighbouring ranges
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    rows = cut(ranged.withColumn("_slice", F.spark_partition_id()))
    per_slice = rows.groupBy(*group, "_slice").agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_slice.select(
        *[F.col(g).alias(f"_group_{g}") for g in group],
        F.col("_slice").alias("_slice_of"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"),
        F.sum("_sum").over(whole).alias("_total"),
    )
    same = F.col("_slice") == F.col("_slice_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    inside = (
        Window.partitionBy(*group, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = rows.withColumn("_inside", F.sum(value).over(inside)).join(shift, same)
    made = {out: F.col("_inside") + F.col("_shift")}
    if total:
        made[total] = F.col("_total")
    return summed.withColumns(made).select(*df.columns, *made)


def exact_median(df: DataFrame, group: list[str], value: str, out: str, upper: bool = False) -> DataFrame:
    """Exact median per group from a histogram of distinct values.

    `upper` takes the upper middle value of an even count instead of the mean of the two.
    """
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    )
    ranked = running_total(hist, group, [F.col(value)], "_n", "_upto", "_all")
    # ranks are 1-based: the middle ones are floor((n+1)/2) and floor(n/2)+1
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor(F.col("_all") / 2) + 1
    from_rank, to_rank = F.col("_upto") - F.col("_n") + 1, F.col("_upto")

    def at(rank):
        return F.max(F.when((from_rank <= rank) & (rank <= to_rank), F.col(value)))

    picked = ranked.groupBy(*group).agg(at(low).alias("_low"), at(high).alias("_high"))
    middle = F.col("_high") if upper else (F.col("_low") + F.col("_high")) / 2
    return picked.select(*group, middle.alias(out))
