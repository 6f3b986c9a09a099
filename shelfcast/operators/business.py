"""Finance, traffic and store questions over the small business tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.expr import check_count, grade, month_key, pct_change, ratio
from shelfcast.functions.ranking import top_k, top_overall
from shelfcast.operators.aggregates import latest_months
from shelfcast.operators.enrich import join_prices

MONEY = ["revenue", "returns", "cogs"]


def _gross_profit() -> Column:
    return F.col("revenue") - F.col("returns") - F.col("cogs")


def monthly_business(business: DataFrame, keys: list[str]) -> DataFrame:
    return (
        business.groupBy(*keys, month_key("date").alias("month"))
        .agg(*[F.sum(c).alias(c) for c in MONEY])
        .withColumn("gross_profit", _gross_profit())
    )


def monthly_revenue(business: DataFrame, months: int = 12) -> DataFrame:
    """The newest months of every store, with the period its data covers."""
    newest = latest_months(monthly_business(business, ["store_nbr"]), check_count(months, "months"), ["store_nbr"])
    period = business.groupBy("store_nbr").agg(
        F.min("date").alias("data_from"), F.max("date").alias("data_to")
    )
    return newest.join(period, "store_nbr")


def compare_stores(business: DataFrame, pairs: DataFrame, months: int = 3) -> DataFrame:
    """Revenue of store pairs over the newest months of each; `pairs` has store_1, store_2."""
    monthly = monthly_business(business, ["store_nbr"])
    totals = (
        latest_months(monthly, check_count(months, "months"), ["store_nbr"])
        .groupBy("store_nbr")
        .agg(F.sum("revenue").alias("_revenue"))
    )

    def side(n: int) -> DataFrame:
        return totals.select(F.col("store_nbr").alias(f"store_{n}"), F.col("_revenue").alias(f"revenue_{n}"))

    both = pairs.join(side(1), "store_1").join(side(2), "store_2")
    positive = F.least("revenue_1", "revenue_2") > 0
    return both.withColumns(
        {
            "difference_pct": F.when(positive, pct_change(F.col("revenue_1"), F.col("revenue_2"))),
            "stronger_store": F.when(F.col("revenue_1") > F.col("revenue_2"), F.col("store_1")).otherwise(
                F.col("store_2")
            ),
        }
    )


def store_traffic(transactions: DataFrame, days: int = 30) -> DataFrame:
    """Invoices of the last `days` days against the `days` before, per store.

    Both windows have the same length; when the table is shorter than two windows they
    are halved.
    """
    days = check_count(days, "days")
    bounds = transactions.agg(F.max("date").alias("hi"), F.min("date").alias("lo"))
    length = F.when(
        F.col("lo") > F.date_sub("hi", 2 * days - 1), F.greatest(F.lit(days // 2), F.lit(1))
    ).otherwise(F.lit(days))
    hi, span = bounds.select("hi").scalar(), bounds.select(length).scalar()
    age = F.datediff(hi, "date")
    invoices = F.col("n_invoices")

    def window(low, high):
        inside = (age >= low) & (age < high)
        return (
            F.coalesce(F.sum(F.when(inside, invoices)), F.lit(0)),
            F.count_if(inside & invoices.isNotNull()),
        )

    (now, now_days), (past, past_days) = window(F.lit(0), span), window(span, 2 * span)
    out = transactions.groupBy("store_nbr").agg(
        now.alias("invoices_now"),
        now_days.alias("active_days_now"),
        past.alias("invoices_before"),
        past_days.alias("active_days_before"),
    )
    return out.withColumns(
        {
            "avg_per_day_now": F.col("invoices_now") / span,
            "trend_pct": pct_change(F.col("invoices_now"), F.col("invoices_before")),
        }
    )


def promotion_impact(stats: DataFrame, per_family: bool = True) -> DataFrame:
    """Units per item-day on and off promotion, lift and verdict."""
    keys = ["store_nbr", "family"] if per_family else ["store_nbr"]

    def total(column: str, flag: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("onpromotion") == flag, F.col(column))), F.lit(0))

    sums = stats.groupBy(*keys).agg(
        total("total_units", 1).alias("_u1"),
        total("item_day_rows", 1).alias("_n1"),
        total("total_units", 0).alias("_u0"),
        total("item_day_rows", 0).alias("_n0"),
    )
    usable = sums.filter((F.col("_n1") > 0) & (F.col("_n0") > 0) & (F.col("_u0") > 0))
    on, off = F.col("_u1") / F.col("_n1"), F.col("_u0") / F.col("_n0")
    lift = (on - off) / off * 100.0
    verdict = F.when(lift >= 20, "effective").when(lift > 0, "moderate").otherwise("ineffective")
    return usable.select(
        *keys,
        on.alias("units_per_item_day_on"),
        off.alias("units_per_item_day_off"),
        lift.alias("lift_pct"),
        verdict.alias("verdict"),
    )


def promotion_days_all_families(sales: DataFrame) -> DataFrame:
    """Days with any promoted sale per store (a day counts once, however many families);
    works on sales or on the daily cube."""
    return sales.filter("onpromotion = 1").groupBy("store_nbr").agg(
        F.count_distinct("date").alias("promo_days")
    )


def gross_margin(business: DataFrame, months: int = 3) -> DataFrame:
    """Monthly margin of every store, oldest first, and its change in points."""
    newest = latest_months(
        monthly_business(business, ["store_nbr"]), check_count(months, "months"), ["store_nbr"]
    )
    margin = ratio(F.col("gross_profit") * 100.0, F.col("revenue"))
    over = Window.partitionBy("store_nbr").orderBy("month")
    return newest.withColumn("margin_pct", margin).withColumn(
        "change_pp", F.col("margin_pct") - F.lag("margin_pct").over(over)
    )


def _since(business: DataFrame, months: int) -> Column:
    return F.add_months(business.agg(F.max("date")).scalar(), -months)


def margin_ranking(business: DataFrame, months: int = 3, k: int = 10) -> DataFrame:
    """Stores by gross margin over the last months, best first."""
    window = business.filter(F.col("date") >= _since(business, check_count(months, "months")))
    sums = window.groupBy("store_nbr").agg(*[F.sum(c).alias(c) for c in MONEY])
    rows = sums.withColumn("gross_profit", _gross_profit()).withColumn(
        "margin_pct", ratio(F.col("gross_profit") * 100.0, F.col("revenue"))
    )
    return top_overall(rows, [F.desc_nulls_last("margin_pct"), F.col("store_nbr")], k)


def monthly_traffic_value(business: DataFrame, transactions: DataFrame) -> DataFrame:
    """Revenue and invoices per store and month."""
    joined = business.join(
        transactions.select("date", "store_nbr", "n_invoices"), ["date", "store_nbr"], "left"
    )
    return joined.groupBy("store_nbr", month_key("date").alias("month")).agg(
        F.sum("revenue").alias("revenue"),
        F.sum(F.coalesce("n_invoices", F.lit(0))).alias("invoices"),
    )


def revenue_bridge(business: DataFrame, transactions: DataFrame, months: int = 6) -> DataFrame:
    """Split the change between neighbouring months into traffic and ticket value."""
    newest = latest_months(
        monthly_traffic_value(business, transactions), check_count(months, "months", 2), ["store_nbr"]
    )
    over = Window.partitionBy("store_nbr").orderBy("month")
    older = {c: F.lag(c).over(over) for c in ("month", "revenue", "invoices")}
    paired = newest.withColumns({f"{c}_older": v for c, v in older.items()}).filter(
        F.col("month_older").isNotNull()
    )
    q_new, q_old = F.col("invoices"), F.col("invoices_older")
    p_new = ratio(F.col("revenue"), q_new, 0.0)
    p_old = ratio(F.col("revenue_older"), q_old, 0.0)
    delta = F.col("revenue") - F.col("revenue_older")
    volume, ticket = (q_new - q_old) * p_old, (p_new - p_old) * q_new
    direction = F.when(delta > 0, "up").otherwise("down")
    cause = F.when(F.abs(volume) >= F.abs(ticket), "traffic").otherwise("ticket")
    return paired.select(
        "store_nbr",
        F.col("month_older").alias("month_from"),
        F.col("month").alias("month_to"),
        delta.alias("revenue_change"),
        volume.alias("volume_effect"),
        ticket.alias("ticket_effect"),
        (delta - volume - ticket).alias("residual"),
        F.concat_ws(" by ", direction, cause).alias("verdict"),
    )


def peer_benchmark(
    business: DataFrame,
    transactions: DataFrame,
    stores: DataFrame,
    months: int = 3,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Each store against the mean of the other stores of its type inside the scope.

    Peer totals are the type's totals less the store's own: no store meets another one.
    """
    window = business.filter(F.col("date") >= _since(business, check_count(months, "months")))
    invoices = transactions.select("date", "store_nbr", "n_invoices")
    own = (
        window.join(invoices, ["date", "store_nbr"], "left")
        .groupBy("store_nbr")
        .agg(
            *[F.sum(c).alias(c) for c in MONEY],
            F.coalesce(F.sum("n_invoices"), F.lit(0)).alias("invoices"),
        )
        .withColumn("gross_profit", _gross_profit())
    )
    sums = ["revenue", "gross_profit", "invoices"]
    typed = stores.select("store_nbr", "type").join(own.select("store_nbr", *sums), "store_nbr", "left")
    typed = typed.na.fill(0, sums)
    peers = typed if scope is None else typed.join(scope, "store_nbr", "left_semi")
    by_type = peers.groupBy("type").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums]
    )
    in_scope = F.lit(1) if scope is None else F.coalesce("_in", F.lit(0))
    if scope is not None:
        typed = typed.join(scope.select("store_nbr", F.lit(1).alias("_in")), "store_nbr", "left")
    joined = typed.join(by_type, "type").withColumn("_own", in_scope)
    count = F.col("_n") - F.col("_own")
    total = {c: F.col(f"_{c}") - F.col("_own") * F.col(c) for c in sums}
    out = joined.filter(count > 0).select(
        "store_nbr",
        "type",
        count.alias("peer_count"),
        "revenue",
        (total["revenue"] / count).alias("peer_revenue"),
        "gross_profit",
        (total["gross_profit"] / count).alias("peer_gross_profit"),
        ratio(F.col("gross_profit") * 100.0, F.col("revenue"), 0.0).alias("margin_pct"),
        ratio(total["gross_profit"] * 100.0, total["revenue"], 0.0).alias("peer_margin_pct"),
        ratio(F.col("revenue"), F.col("invoices"), 0.0).alias("avg_ticket"),
        ratio(total["revenue"], total["invoices"], 0.0).alias("peer_avg_ticket"),
    )
    compared = {
        f"{m}_vs_peer_pct": pct_change(F.col(m), F.col(f"peer_{m}"))
        for m in ("revenue", "gross_profit", "margin_pct", "avg_ticket")
    }
    return out.withColumns(compared)


def weekly_pattern(business: DataFrame, weeks: int = 12) -> DataFrame:
    """Mean daily revenue per weekday (Sunday 0) with the store's best and worst day and
    its weekend lift."""
    weeks = check_count(weeks, "weeks", 2)
    since = F.date_sub(business.agg(F.max("date")).scalar(), weeks * 7)
    by_day = (
        business.filter(F.col("date") >= since)
        .groupBy("store_nbr", (F.dayofweek("date") - 1).alias("dow"))
        .agg(F.avg("revenue").alias("avg_revenue"), F.count(F.lit(1)).alias("days_observed"))
    )
    weekend = F.col("dow").isin(0, 6)
    # ties between days go to the earlier day
    best = F.max(F.struct("avg_revenue", (-F.col("dow")).alias("d")))
    worst = F.min(F.struct("avg_revenue", F.col("dow").alias("d")))
    summary = by_day.groupBy("store_nbr").agg(
        F.avg(F.when(weekend, F.col("avg_revenue"))).alias("weekend_avg"),
        F.avg(F.when(~weekend, F.col("avg_revenue"))).alias("weekday_avg"),
        (-best["d"]).alias("best_dow"),
        worst["d"].alias("worst_dow"),
    )
    summary = summary.withColumn(
        "weekend_lift_pct", pct_change(F.col("weekend_avg"), F.col("weekday_avg"))
    )
    return by_day.join(summary, "store_nbr")


def family_mix_gap(sold: DataFrame, items: DataFrame, prices: DataFrame) -> DataFrame:
    """Value share of each family in the store against the chain, in points."""
    value = (
        join_prices(
            sold.join(items.select("item_nbr", "family"), "item_nbr")
            .groupBy("store_nbr", "family")
            .agg(F.sum("unit_sales").alias("_units")),
            prices,
        )
        .withColumn("_value", F.col("_units") * F.col("unit_price"))
        .select("store_nbr", "family", "_value")
    )
    by_store = value.groupBy("store_nbr").agg(F.sum("_value").alias("_store"))
    by_family = value.groupBy("family").agg(F.sum("_value").alias("_family"))
    chain = value.agg(F.sum("_value")).scalar()
    store_share = F.col("_value") / F.col("_store") * 100.0
    chain_share = F.col("_family") / F.nullif(chain, F.lit(0.0)) * 100.0
    joined = value.join(by_store.filter("_store > 0"), "store_nbr").join(by_family, "family")
    return joined.select(
        "store_nbr",
        "family",
        store_share.alias("store_share_pct"),
        chain_share.alias("chain_share_pct"),
        (store_share - chain_share).alias("diff_pp"),
    )


def family_mix_extremes(gaps: DataFrame, k: int = 8, points: float = 1.0) -> DataFrame:
    """Families sold clearly below (`under`) or above (`over`) the chain share."""
    side = F.when(F.col("diff_pp") < -points, "under").when(F.col("diff_pp") > points, "over")
    marked = gaps.withColumn("side", side).filter(F.col("side").isNotNull())
    return top_k(
        marked, ["store_nbr", "side"], [F.desc(F.abs("diff_pp")), F.col("family")], k
    )


def store_profile(
    stores: DataFrame, inventory: DataFrame, business: DataFrame
) -> DataFrame:
    """Store attributes, managed items and latest month of revenue."""
    managed = inventory.groupBy("store_nbr").agg(F.count(F.lit(1)).alias("managed_items"))
    monthly = monthly_business(business, ["store_nbr"]).select("store_nbr", "month", "revenue")
    newest = latest_months(monthly, 1, ["store_nbr"]).select(
        "store_nbr", F.col("month").alias("latest_month"), F.col("revenue").alias("latest_revenue")
    )
    out = stores.select("store_nbr", "city", "state", "type", "cluster")
    out = out.join(managed, "store_nbr", "left").join(newest, "store_nbr", "left")
    return out.withColumn("managed_items", F.coalesce("managed_items", F.lit(0)))


def store_top_families(family_forecast: DataFrame, k: int = 3) -> DataFrame:
    totals = family_forecast.groupBy("store_nbr", "family").agg(
        grade(F.sum("predicted_sales")).alias("forecast")
    )
    return top_k(totals, ["store_nbr"], [F.desc("forecast"), F.col("family")], k)


def cluster_trend(forecasts: DataFrame, stores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Forecast totals of cluster pairs; `pairs` has cluster_1 and cluster_2."""
    by_store = forecasts.groupBy("store_nbr").agg(F.sum("predicted_sales").alias("_units"))
    totals = (
        by_store.join(stores.select("store_nbr", "cluster"), "store_nbr")
        .groupBy("cluster")
        .agg(F.sum("_units").alias("_units"))
    )

    def side(n: int) -> DataFrame:
        return totals.select(F.col("cluster").alias(f"cluster_{n}"), F.col("_units").alias(f"sales_{n}"))

    both = pairs.join(side(1), "cluster_1").join(side(2), "cluster_2")
    return both.withColumns(
        {
            "difference_pct": F.when(
                F.col("sales_2") != 0,
                (F.col("sales_1") - F.col("sales_2")) / F.col("sales_2") * 100.0,
            ).otherwise(0.0),
            "stronger_cluster": F.when(F.col("sales_1") > F.col("sales_2"), F.col("cluster_1")).otherwise(
                F.col("cluster_2")
            ),
        }
    )
