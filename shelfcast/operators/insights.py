"""Readings of the sales history: growth, day detail, automatic findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.expr import pct_change, ratio
from shelfcast.functions.ranking import top_k
from shelfcast.operators.aggregates import period_family_units, period_units


def period_growth(periods: DataFrame, value: str = "total") -> DataFrame:
    """Growth against the period before; one row per period, so one ordered pass is small."""
    before = F.lag(value).over(Window.orderBy("period"))
    return periods.withColumn("growth_pct", pct_change(F.col(value), before))


def day_detail(history: DataFrame) -> DataFrame:
    """Each day against the previous available day and the mean of the seven before it."""
    daily = history.groupBy("date").agg(F.sum("unit_sales").alias("total"))
    over = Window.orderBy("date")
    week = F.avg("total").over(over.rowsBetween(-7, -1))
    return daily.withColumns(
        {
            "vs_previous_pct": pct_change(F.col("total"), F.lag("total").over(over)),
            "vs_week_pct": pct_change(F.col("total"), week),
        }
    )


def day_top_families(history: DataFrame, k: int = 10) -> DataFrame:
    by_family = history.groupBy("date", "family").agg(F.sum("unit_sales").alias("units"))
    return top_k(by_family, ["date"], [F.desc("units"), F.col("family")], k)


def half_year_change(history: DataFrame, grain: str = "month", floor: float = 500.0) -> DataFrame:
    """Change of each family between the first and the second half of the periods.

    Families with less than `floor` units in the first half are too small to judge.
    """
    units = period_family_units(history, grain)
    periods = units.select("period").distinct()
    # the list of periods is a calendar: one row per period
    placed = periods.withColumn("_at", F.row_number().over(Window.orderBy("period")) - 1)
    half = F.floor(periods.agg(F.count(F.lit(1))).scalar() / 2)
    early = F.col("_at") < half
    sums = (
        units.join(placed, "period")
        .groupBy("family")
        .agg(
            F.sum(F.when(early, F.col("units")).otherwise(0.0)).alias("first_half"),
            F.sum(F.when(~early, F.col("units"))).alias("second_half"),
        )
    )
    judged = sums.filter((F.col("first_half") >= floor) & F.col("second_half").isNotNull())
    return judged.withColumn("change_pct", pct_change(F.col("second_half"), F.col("first_half")))


def insights(history: DataFrame, grain: str = "month") -> DataFrame:
    """Findings as rows (kind, tone, subject, value): fastest and slowest family, peak day,
    perishable share, leader share, growth of the last period."""
    periods = period_units(history, grain)
    change = half_year_change(history, grain)
    best = change.agg(F.max(F.struct("change_pct", "family")).alias("b")).select("b.*")
    worst = change.agg(F.min(F.struct("change_pct", "family")).alias("b")).select("b.*")
    daily = history.groupBy("date").agg(F.sum("unit_sales").alias("units"))
    peak = daily.agg(F.max_by("date", F.struct("units", -F.unix_date("date"))).alias("d"), F.max("units").alias("v"))
    share = periods.agg(ratio(F.sum("perishable_units") * 100.0, F.sum("total")).alias("v"))
    families = history.groupBy("family").agg(F.sum("unit_sales").alias("units"))
    leader = families.agg(
        F.max(F.struct("units", "family")).alias("b"), F.sum("units").alias("all")
    ).select("b.family", ratio(F.col("b.units") * 100.0, F.col("all")).alias("v"))
    growth = top_k(
        period_growth(periods).withColumn("_all", F.lit(1)), ["_all"], [F.desc("period")], 1
    )

    def finding(df: DataFrame, kind: str, tone, subject, value, keep) -> DataFrame:
        return df.filter(keep).select(
            F.lit(kind).alias("kind"), tone.alias("tone"), subject.alias("subject"), value.alias("value")
        )

    good, bad, info, warn = (F.lit(t) for t in ("good", "bad", "info", "warn"))
    change_pct, v = F.col("change_pct"), F.col("v")
    parts = [
        finding(best, "fastest family", good, F.col("family"), change_pct, change_pct > 5),
        finding(worst, "slowest family", bad, F.col("family"), change_pct, change_pct < -5),
        finding(peak, "peak day", info, F.col("d").cast("string"), v, v.isNotNull()),
        finding(share, "perishable share", warn, F.lit("perishable"), v, v >= 30),
        finding(leader, "leading family", F.when(v >= 40, warn).otherwise(info), F.col("family"), v, v.isNotNull()),
        finding(
            growth,
            "last period",
            F.when(F.col("growth_pct") >= 0, good).otherwise(bad),
            F.col("period"),
            F.col("growth_pct"),
            F.col("growth_pct").isNotNull(),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
