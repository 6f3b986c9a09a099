"""What-if scenarios for any number of (store, family, override) rows in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.constants import (
    COVER_CAP_DAYS,
    DEFAULT_LEAD_TIME,
    HORIZON_DAYS,
    NORMAL_DAY,
    OVERSTOCK_DAYS,
    QUAKE_WORD,
    SCENARIO_DEFAULT_PRICE,
)
from shelfcast.functions.expr import clipped, finite, grade, ratio
from shelfcast.functions.ranking import top_k
from shelfcast.functions.series import SERIES_KEYS
from shelfcast.operators.aggregates import promotion_days, shares_from_forecasts
from shelfcast.operators.enrich import join_holidays, transactions_lag
from shelfcast.operators.forecast import DRIVER_FEATURES, driver_values, forecast_recursive
from shelfcast.operators.panel import attach_drivers, to_family

HISTORY_DAYS = 90

# allowed range of each numeric override: name, low, high, may be null
PARAMETER_RANGES = [
    ("horizon_days", 7, 16, False),
    ("demand_multiplier", 0, 10, False),
    ("promo_days", 0, 16, True),
    ("oil_price", 20, 200, True),
    ("traffic_change_pct", -90, 200, True),
    ("event_days", 0, 16, False),
    ("stock_override", 0, None, True),
    ("lead_time_override", 0, 60, True),
]
EVENTS = ["none", "holiday", "earthquake"]
DEFAULTS = {
    "horizon_days": HORIZON_DAYS,
    "demand_multiplier": 1.0,
    "promo_days": None,
    "oil_price": None,
    "traffic_change_pct": None,
    "event_type": "none",
    "event_days": 0,
    "stock_override": None,
    "lead_time_override": None,
}
TYPES = {
    "horizon_days": "int",
    "demand_multiplier": "double",
    "promo_days": "int",
    "oil_price": "double",
    "traffic_change_pct": "double",
    "event_type": "string",
    "event_days": "int",
    "stock_override": "double",
    "lead_time_override": "double",
}


def with_defaults(overrides: DataFrame) -> DataFrame:
    """Override rows with every parameter column present."""
    out = overrides
    for name, value in DEFAULTS.items():
        default = F.lit(value).cast(TYPES[name])
        current = F.col(name).cast(TYPES[name]) if name in overrides.columns else default
        out = out.withColumn(name, F.coalesce(current, default))
    return out


def _problems() -> dict[str, Column]:
    """Per parameter: is its value outside the allowed range?"""

    def outside(name: str, low, high, nullable: bool) -> Column:
        value = F.col(name).cast("double")
        bad = F.isnan(value) | (F.abs(value) == float("inf")) | (value < low)
        if high is not None:
            bad = bad | (value > high)
        return F.coalesce(bad, F.lit(not nullable))

    found = {r[0]: outside(*r) for r in PARAMETER_RANGES}
    found["event_type"] = ~F.coalesce(F.col("event_type").isin(EVENTS), F.lit(False))
    return found


def check_overrides(overrides: DataFrame) -> DataFrame:
    """Add `rejected`: the names of parameters outside their range, empty when valid."""
    named = [F.when(bad, F.lit(name)) for name, bad in _problems().items()]
    return overrides.withColumn("rejected", F.array_compact(F.array(*named)))


def valid_overrides(overrides: DataFrame) -> DataFrame:
    return overrides.filter(~reduce(lambda a, b: a | b, _problems().values()))


def rejected_overrides(overrides: DataFrame) -> DataFrame:
    return check_overrides(overrides).filter(F.size("rejected") > 0)


def history(
    sales: DataFrame,
    stores: DataFrame,
    items: DataFrame,
    oil: DataFrame,
    holidays: DataFrame,
    transactions: DataFrame,
    last_day: Column,
    days: int = HISTORY_DAYS,
) -> DataFrame:
    """The last `days` days of every series with promotion, statics and drivers."""
    recent = sales.filter((F.col("date") > F.date_sub(last_day, days)) & (F.col("date") <= last_day))
    rows = attach_drivers(to_family(recent, items), stores, oil, holidays)
    lagged = rows.join(transactions_lag(transactions), ["store_nbr", "date"], "left")
    return lagged.withColumn("target", clipped("unit_sales"))


def window_days(forecasts: DataFrame) -> DataFrame:
    """The forecast days in order with their index, one row per day."""
    days = forecasts.select("date").distinct()
    # one row per calendar day of the horizon
    return days.withColumn("day_index", F.row_number().over(Window.orderBy("date")) - 1)


def future_drivers(
    overrides: DataFrame,
    days: DataFrame,
    stores: DataFrame,
    oil: DataFrame,
    holidays: DataFrame,
    planned: DataFrame,
    last_traffic: DataFrame,
) -> DataFrame:
    """Drivers per scenario and day: the plan, with the overrides laid over its first days."""
    horizon = days.groupBy().agg(F.array_sort(F.collect_list(F.struct("day_index", "date"))).alias("_d"))
    spine = overrides.withColumn("_days", F.slice(horizon.scalar(), F.lit(1), F.col("horizon_days")))
    spine = spine.select(*overrides.columns, F.inline("_days"))
    base = join_holidays(
        spine.withColumnRenamed("oil_price", "_oil_override")
        .join(stores.select("store_nbr", "city", "state"), "store_nbr")
        .join(oil, "date", "left"),
        holidays,
    )
    base = base.join(
        planned.withColumnRenamed("onpromotion", "_planned"), ["date", "store_nbr", "family"], "left"
    ).join(last_traffic, "store_nbr", "left")
    i = F.col("day_index")
    in_event = i < F.col("event_days")
    quake = F.coalesce(F.lower("holiday_description").contains(QUAKE_WORD), F.lit(False))
    factor = F.greatest(F.lit(0.0), 1 + F.col("traffic_change_pct") / 100.0)
    planned_type = F.coalesce("holiday_type", F.lit(NORMAL_DAY))
    plan = [
        F.coalesce("_planned", F.lit(0)).alias("plan_promotion"),
        F.col("oil_price").alias("plan_oil_price"),
        planned_type.alias("plan_holiday_type"),
        quake.alias("plan_earthquake"),
        F.col("last_traffic").alias("plan_traffic"),
    ]
    return base.select(
        "scenario_id",
        "store_nbr",
        "family",
        "date",
        "day_index",
        F.when(F.col("promo_days").isNotNull(), (i < F.col("promo_days")).cast("int"))
        .otherwise(F.coalesce("_planned", F.lit(0)))
        .alias("onpromotion"),
        F.coalesce("_oil_override", "oil_price").alias("oil_price"),
        F.when(in_event & (F.col("event_type") == "holiday"), "Holiday")
        .when(in_event & (F.col("event_type") == "earthquake"), "Event")
        .otherwise(F.coalesce("holiday_type", F.lit(NORMAL_DAY)))
        .alias("holiday_type"),
        F.when(in_event & (F.col("event_type") == "holiday"), F.lit(False))
        .when(in_event & (F.col("event_type") == "earthquake"), F.lit(True))
        .otherwise(quake)
        .alias("is_earthquake_period"),
        F.when(
            F.col("traffic_change_pct").isNotNull(),
            F.greatest(F.lit(0.0), F.coalesce("last_traffic", F.lit(0.0)) * factor),
        ).alias("transactions_lag1"),
        *plan,
    )


def driver_effects(drivers: DataFrame, driver_models: DataFrame) -> DataFrame:
    """`effect` per scenario and day: what the overridden drivers add to the plan's, in log units.

    `drivers` comes from `future_drivers`, `driver_models` from `train_drivers`; traffic that isn't
    overridden stays as planned.
    """
    traffic = F.coalesce("transactions_lag1", "plan_traffic")
    new = driver_values(F.col("oil_price"), F.col("holiday_type"), F.col("is_earthquake_period"), traffic)
    old = driver_values(F.col("plan_oil_price"), F.col("plan_holiday_type"), F.col("plan_earthquake"), F.col("plan_traffic"))
    moved = [F.col("driver_coef")[i] * (new[c] - old[c]) for i, c in enumerate(DRIVER_FEATURES)]
    joined = drivers.join(driver_models.select("family", "driver_coef"), "family", "left")
    return joined.withColumn("effect", F.coalesce(reduce(lambda a, b: a + b, moved), F.lit(0.0))).drop("driver_coef")


def latest_traffic(history_rows: DataFrame) -> DataFrame:
    """Last known traffic lag of each store's history."""
    known = history_rows.filter("transactions_lag1 IS NOT NULL")
    return known.groupBy("store_nbr").agg(
        F.max_by("transactions_lag1", "date").cast("double").alias("last_traffic")
    )


def family_stock(inventory: DataFrame, items: DataFrame) -> DataFrame:
    """Stock, mean lead time and number of items per store and family."""
    joined = inventory.join(items.select("item_nbr", "family"), "item_nbr")
    return joined.groupBy("store_nbr", "family").agg(
        F.coalesce(F.sum("current_stock"), F.lit(0.0)).alias("stock"),
        F.coalesce(F.avg("lead_time_days"), F.lit(float(DEFAULT_LEAD_TIME))).alias("lead_time"),
        F.count(F.lit(1)).alias("sku_count"),
    )


def unit_prices(families: DataFrame, prices: DataFrame) -> DataFrame:
    """Price per family; an unknown or zero price falls back to the scenario default."""
    keyed = prices.select(F.upper("family").alias("_f"), F.col("unit_price").alias("_p"))
    joined = families.select("family").distinct().join(keyed, F.upper("family") == F.col("_f"), "left")
    price = F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.lit(SCENARIO_DEFAULT_PRICE))
    return joined.select("family", price.alias("unit_price"))


def baseline(family_forecast: DataFrame, overrides: DataFrame, days: DataFrame) -> DataFrame:
    """Baseline per scenario and day over the scenario's own horizon."""
    keyed = overrides.select("scenario_id", "store_nbr", "family", "horizon_days")
    dated = family_forecast.join(days, "date")
    return (
        keyed.join(dated, ["store_nbr", "family"])
        .filter(F.col("day_index") < F.col("horizon_days"))
        .select(
            "scenario_id", "store_nbr", "family", "date", F.col("predicted_sales").alias("baseline_sales")
        )
    )


def outcome(totals: DataFrame) -> DataFrame:
    """Key figures and verdict from totals.

    `totals` has baseline_total, scenario_total, stock, unit_price and horizon_days.
    """
    old, new, stock = F.col("baseline_total"), F.col("scenario_total"), F.col("stock")
    daily = F.when(F.col("horizon_days") > 0, new / F.col("horizon_days")).otherwise(0.0)
    cover = F.when(daily > 0, F.least(F.lit(COVER_CAP_DAYS), stock / daily)).otherwise(F.lit(COVER_CAP_DAYS))
    short = F.greatest(F.lit(0.0), new - stock)
    out = totals.withColumns(
        {
            "delta": new - old,
            "delta_pct": ratio((new - old) * 100.0, old),
            "days_of_cover": cover,
            "shortfall": short,
            "excess": F.greatest(F.lit(0.0), stock - new),
            "will_stockout": short > 0,
            "overstock": (short <= 0) & (cover > OVERSTOCK_DAYS) & (new > 0),
            "expected_revenue": new * F.col("unit_price"),
            "baseline_revenue": old * F.col("unit_price"),
            "lost_revenue": short * F.col("unit_price"),
        }
    )
    severity = F.col("shortfall") / F.greatest(stock, F.lit(1.0))
    short_risk = (
        F.when(severity > 2, "very high").when(severity > 1, "high").when(severity > 0.3, "medium").otherwise("low")
    )
    return out.withColumns(
        {
            "risk_level": F.when(F.col("will_stockout"), short_risk)
            .when(F.col("overstock"), "overstock")
            .otherwise("safe"),
            "verdict": F.when(F.col("will_stockout"), "stock-out ahead")
            .when(F.col("overstock"), "overstocked")
            .otherwise("enough stock"),
        }
    )


def sku_movements(
    totals: DataFrame, forecasts: DataFrame, items: DataFrame, inventory: DataFrame, k: int = 8
) -> DataFrame:
    """The k items of each scenario whose demand moves most, from forecast shares."""
    shares = shares_from_forecasts(forecasts, items)
    stock = inventory.select("store_nbr", "item_nbr", F.col("current_stock").alias("item_stock"))
    split = totals.select("scenario_id", "store_nbr", "family", "baseline_total", "scenario_total").join(
        shares, ["store_nbr", "family"]
    )
    base, new = F.col("baseline_total") * F.col("share"), F.col("scenario_total") * F.col("share")
    moved = split.join(stock, ["store_nbr", "item_nbr"], "left").select(
        "scenario_id",
        "store_nbr",
        "item_nbr",
        base.alias("item_baseline"),
        new.alias("item_scenario"),
        (new - base).alias("item_delta"),
        ratio((new - base) * 100.0, base).alias("item_delta_pct"),
        F.greatest(F.lit(0.0), new - F.coalesce("item_stock", F.lit(0.0))).alias("item_shortfall"),
    )
    # graded, so that items of equal share rank by number and not by the last bits
    return top_k(moved, ["scenario_id"], [F.desc(grade(F.abs("item_delta"))), F.col("item_nbr")], k)


def scenario_totals(
    overrides: DataFrame,
    baseline_rows: DataFrame,
    predicted: DataFrame,
    stock: DataFrame,
    prices: DataFrame,
) -> DataFrame:
    """Totals per scenario.

    `predicted` has `prediction` under the scenario and `planned` under the plan, by the same model:
    their difference is what the overrides change, and it is added to the baseline, so a neutral
    scenario is the baseline.  Series without a model keep the baseline (`source` says which); the
    demand factor is applied once, to the result.
    """
    keys = ["scenario_id", "store_nbr", "family"]
    base = baseline_rows.groupBy(*keys).agg(
        F.sum("baseline_sales").alias("baseline_total"), F.count(F.lit(1)).alias("_days")
    )
    model = predicted.groupBy(*keys).agg((F.sum("prediction") - F.sum("planned")).alias("_change"))
    joined = (
        overrides.join(base, keys)
        .join(model, keys, "left")
        .join(stock, ["store_nbr", "family"], "left")
        .join(prices, "family", "left")
    )
    factor = F.col("demand_multiplier")
    return joined.withColumns(
        {
            "source": F.when(F.col("_change").isNotNull(), "model").otherwise("scaled baseline"),
            "scenario_total": F.greatest(
                F.lit(0.0), F.col("baseline_total") + F.coalesce("_change", F.lit(0.0))
            ) * factor,
            "stock": F.coalesce("stock_override", "stock", F.lit(0.0)),
            "lead_time": F.coalesce("lead_time_override", "lead_time", F.lit(float(DEFAULT_LEAD_TIME))),
            "unit_price": F.coalesce(finite("unit_price"), F.lit(SCENARIO_DEFAULT_PRICE)),
        }
    ).drop("_days", "_change")


def run_scenarios(
    overrides: DataFrame,
    panel: DataFrame,
    models: DataFrame,
    family_forecast: DataFrame,
    drivers: DataFrame,
    days: DataFrame,
    inventory: DataFrame,
    items: DataFrame,
    prices: DataFrame,
    driver_models: DataFrame,
) -> DataFrame:
    """All scenarios in one job: baseline, forecast under the drivers, outcome.

    `drivers` comes from `future_drivers`, `driver_models` from `train_drivers`; scenario and plan
    are two futures of one recursion.  Series without a model fall back to the baseline.
    """
    keys = ["scenario_id", *SERIES_KEYS]
    under = driver_effects(drivers, driver_models)
    new = under.select(*keys, "date", "onpromotion", "effect", F.lit(True).alias("changed"))
    plan = under.select(*keys, "date", F.col("plan_promotion").alias("onpromotion"), F.lit(0.0).alias("effect"), F.lit(False).alias("changed"))
    both = forecast_recursive(panel, new.unionByName(plan), models, [*keys, "changed"])
    predicted = both.groupBy(*keys, "date").agg(
        F.sum(F.when(F.col("changed"), F.col("prediction"))).alias("prediction"),
        F.sum(F.when(~F.col("changed"), F.col("prediction"))).alias("planned"),
    )
    totals = scenario_totals(
        overrides,
        baseline(family_forecast, overrides, days),
        predicted,
        family_stock(inventory, items),
        unit_prices(items, prices),
    )
    return outcome(totals)


def form_defaults(
    inventory: DataFrame,
    items: DataFrame,
    prices: DataFrame,
    planned: DataFrame,
    oil: DataFrame,
    history_rows: DataFrame,
    first_day: Column,
) -> DataFrame:
    """Prefill values per store and family."""
    oil_now = oil.filter(F.col("date") <= first_day).agg(F.max_by("oil_price", "date")).scalar()
    return (
        family_stock(inventory, items)
        .join(unit_prices(items, prices), "family", "left")
        .join(promotion_days(planned), ["store_nbr", "family"], "left")
        .join(latest_traffic(history_rows), "store_nbr", "left")
        .select(
            "store_nbr",
            "family",
            "stock",
            "lead_time",
            "sku_count",
            "unit_price",
            F.coalesce("promo_days", F.lit(0)).alias("baseline_promo_days"),
            oil_now.alias("current_oil_price"),
            F.coalesce("last_traffic", F.lit(0.0)).alias("last_transactions"),
        )
    )
