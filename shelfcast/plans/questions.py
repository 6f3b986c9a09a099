"""The business questions by name, with parameters and row-level access.

    ask(t, "stockout_risk", user="manager7", store_nbr=7)

Access is applied to the tables a question reads, so no question can forget it.  Without a
store the answer covers every store the user may see.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import aggregates, business, dashboards, inventory, scenario, scope
from shelfcast.operators.forecast import forecast_recursive
from shelfcast.plans.serving import RetailTables
from shelfcast.sources.snapshots import Snapshot, Transaction
from shelfcast.sources.tables import apply_restock, unknown_restocks

PAIR = ["store_nbr", "item_nbr"]
# tables without a store that every user may see; tables with `store_nbr` are cut to the user's
# scope, and anything else is refused
CHAIN_WIDE = {"driver_models", "holidays", "items", "local_models", "oil", "prices", "sku_stats"}
PLAIN_VALUES = {"horizon", "origin", "origin_date"}


class VisibleTables:
    """Serving tables as one user sees them, optionally for one store."""

    def __init__(self, tables: RetailTables, user: str, admin: bool = False, store_nbr: int | None = None):
        self.all = tables
        self.user, self.admin, self.store_nbr = user, admin, store_nbr
        # refuse at once, not at the first table
        scope.scope(tables.stores, tables.access, user, admin, store_nbr)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        value = getattr(self.all, name)
        if name in PLAIN_VALUES:
            return value
        if not isinstance(value, DataFrame):
            raise scope.AccessDenied(f"{name} is not open to questions")
        if "store_nbr" not in value.columns:
            if name not in CHAIN_WIDE:
                raise scope.AccessDenied(f"{name} is not open to questions")
            return value
        if self.store_nbr is not None:  # already checked; a plain filter reaches the scan
            return value.filter(F.col("store_nbr") == self.store_nbr)
        return value if self.admin else value.join(self.allowed, "store_nbr", "left_semi")

    @cached_property
    def allowed(self) -> DataFrame | None:
        """Stores of the user's scope, or None for administrators."""
        return None if self.admin else scope.user_scope(self.all.access, self.user)

    def require(self, stores: DataFrame) -> None:
        scope.check_stores(stores, self.all.access, self.user, self.admin)


QUESTIONS: dict[str, Callable[..., DataFrame]] = {}


def question(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    QUESTIONS[build.__name__] = build
    return build


def ask(
    tables: RetailTables, name: str, user: str, admin: bool = False, store_nbr: int | None = None, **params
) -> DataFrame:
    """Answer one question for a user; unknown names and forbidden stores raise."""
    if name not in QUESTIONS:
        raise KeyError(f"unknown question {name!r}; known: {sorted(QUESTIONS)}")
    return QUESTIONS[name](VisibleTables(tables, user, admin, store_nbr), **params)


def restock(tables: RetailTables, restocks: DataFrame, user: str, at: str, admin: bool = False, token: str | None = None) -> Snapshot:
    """Commit the inventory with `restocks` (store_nbr, item_nbr, quantity) added.

    Refused when a store is outside the user's scope or an item is not managed there.  It is added to the
    newest inventory of any session over the same tables, so restocks of several sessions add up.  With a
    `token` of the caller's choice, a restock that is sent again after a failure counts once.
    """
    scope.check_stores(restocks, tables.access, user, admin)

    def add(txn: Transaction) -> None:
        tables.refresh(txn.base)
        if not unknown_restocks(tables.inventory, restocks).isEmpty():
            raise KeyError("a restock names an item its store does not manage")
        txn.write("inventory", apply_restock(tables.inventory, restocks, at))

    done = tables.snapshots.commit(add, reads=("forecasts", "inventory"), token=token)
    tables.refresh(done)
    return done


def _of_item(df: DataFrame, item_nbr: int | None) -> DataFrame:
    return df if item_nbr is None else df.filter(F.col("item_nbr") == item_nbr)


# ---------------------------------------------------------------- forecast and stock


@question
def sales_summary(t: VisibleTables, days: int = 7) -> DataFrame:
    return dashboards.sales_summary(t.forecasts, t.items, days)


@question
def stockout_risk(t: VisibleTables, top_n: int = 10) -> DataFrame:
    return inventory.stockout_risk(t.position, top_n)


@question
def reorder_point(t: VisibleTables, item_nbr: int | None = None) -> DataFrame:
    return inventory.reorder_point(_of_item(t.position, item_nbr))


@question
def purchase_target(t: VisibleTables, item_nbr: int | None = None, safety_days: float | None = None) -> DataFrame:
    return inventory.purchase_target(_of_item(t.position, item_nbr), safety_days)


@question
def demand_multiplier(t: VisibleTables, multiplier: float, item_nbr: int | None = None) -> DataFrame:
    return inventory.demand_multiplier(_of_item(t.position, item_nbr), multiplier)


@question
def stockout_loss(t: VisibleTables, days: float, item_nbr: int | None = None) -> DataFrame:
    return inventory.stockout_loss(inventory.demand(_of_item(t.forecasts, item_nbr)), days)


@question
def run_scenario(t: VisibleTables, family: str | None = None, **overrides) -> DataFrame:
    """Scenarios with the same overrides for every visible series (of one family, if named);
    parameters outside their range raise."""
    unknown = set(overrides) - set(scenario.DEFAULTS)
    if unknown:
        raise ValueError(f"unknown scenario parameters {sorted(unknown)}")
    series = t.family_prediction.select("store_nbr", "family").distinct()
    if family is not None:
        series = series.filter(F.upper("family") == family.upper())
    rows = series.withColumns(
        {
            "scenario_id": F.xxhash64("store_nbr", "family"),
            **{k: F.lit(v).cast(scenario.TYPES[k]) for k, v in overrides.items()},
        }
    )
    wanted = scenario.with_defaults(rows)
    rejected = scenario.rejected_overrides(wanted).select("rejected").first()
    if rejected:
        raise ValueError(f"scenario parameters out of range: {rejected[0]}")
    whole = t.all
    days = scenario.window_days(whole.forecasts)
    traffic = t.transactions.groupBy("store_nbr").agg(
        F.max_by("transactions", "date").cast("double").alias("last_traffic")
    )
    drivers = scenario.future_drivers(
        wanted, days, t.stores, whole.oil, whole.holidays, t.planned_promotions, traffic
    )
    return scenario.run_scenarios(
        wanted, t.panel, whole.local_models, t.family_forecast, drivers, days, t.inventory, whole.items, whole.prices,
        whole.driver_models,
    )


@question
def cross_sell(t: VisibleTables, item_nbr: int | None = None) -> DataFrame:
    demand = inventory.demand(t.forecasts)
    wanted = None if item_nbr is None else _of_item(demand.select(*PAIR), item_nbr)
    return inventory.cross_sell(demand, t.items, wanted)


@question
def slow_movers(t: VisibleTables, top_n: int = 5) -> DataFrame:
    return inventory.slow_movers(t.position, top_n)


@question
def cluster_trend(t: VisibleTables, cluster_1: int, cluster_2: int) -> DataFrame:
    t.require(t.all.stores.filter(F.col("cluster").isin(cluster_1, cluster_2)))
    pair = t.all.stores.select(F.lit(cluster_1).alias("cluster_1"), F.lit(cluster_2).alias("cluster_2")).limit(1)
    return business.cluster_trend(t.forecasts, t.stores, pair)


# ---------------------------------------------------------------- actual business


@question
def monthly_revenue(t: VisibleTables, months: int = 1) -> DataFrame:
    return business.monthly_revenue(t.business, months)


@question
def compare_stores(t: VisibleTables, store_1: int, store_2: int, months: int = 3) -> DataFrame:
    both = t.all.stores.filter(F.col("store_nbr").isin(store_1, store_2))
    t.require(both)
    pair = both.select(F.lit(store_1).alias("store_1"), F.lit(store_2).alias("store_2")).limit(1)
    return business.compare_stores(t.business, pair, months)


@question
def top_items(t: VisibleTables, top_n: int = 5) -> DataFrame:
    return dashboards.top_items_per_store(t.sold, t.items, top_n)


@question
def family_forecast(t: VisibleTables, family: str, days: int = 7) -> DataFrame:
    """Daily forecast of one family; a name outside the catalogue raises (`families` lists them)."""
    families = dashboards.product_families(t.items)
    if families.filter(F.upper("family") == family.strip().upper()).isEmpty():
        raise ValueError(f"unknown family {family!r}")
    return dashboards.family_forecast_days(t.family_forecast, days, family)


@question
def item_profile(t: VisibleTables, item_nbr: int | None = None, nested: bool = False) -> DataFrame:
    rows = inventory.item_profile(
        _of_item(t.items, item_nbr),
        _of_item(t.inventory, item_nbr),
        _of_item(t.forecasts, item_nbr),
        _of_item(t.sold, item_nbr),
    )
    return inventory.item_profile_nested(rows) if nested else rows


@question
def store_profile(t: VisibleTables) -> DataFrame:
    return business.store_profile(t.stores, t.inventory, t.business)


@question
def store_families(t: VisibleTables, top_n: int = 3) -> DataFrame:
    return business.store_top_families(t.family_forecast, top_n)


@question
def store_traffic(t: VisibleTables, days: int = 30) -> DataFrame:
    return business.store_traffic(t.transactions, days)


@question
def promotion_impact(t: VisibleTables, family: str | None = None) -> DataFrame:
    """Over all families, or for one."""
    if family is None:
        return business.promotion_impact(t.promo_stats, per_family=False)
    return business.promotion_impact(t.promo_stats.filter(F.upper("family") == family.upper()))


@question
def perishable_risk(t: VisibleTables, top_n: int = 10) -> DataFrame:
    return inventory.perishable_risk(t.position, top_n)


# ---------------------------------------------------------------- finance


@question
def gross_margin(t: VisibleTables, months: int = 3) -> DataFrame:
    """Monthly series for one store; a ranking of stores otherwise."""
    if t.store_nbr is not None:
        return business.gross_margin(t.business, months)
    return business.margin_ranking(t.business, months)


@question
def revenue_bridge(t: VisibleTables, months: int = 2) -> DataFrame:
    return business.revenue_bridge(t.business, t.transactions, months)


@question
def peer_benchmark(t: VisibleTables, months: int = 3) -> DataFrame:
    """Peers are the user's own stores of the same type, even when one store is asked for."""
    everything = business.peer_benchmark(
        t.all.business, t.all.transactions, t.all.stores, months, scope=t.allowed
    )
    return everything.join(t.stores.select("store_nbr"), "store_nbr", "left_semi")


@question
def reorder_profit(t: VisibleTables, top_n: int = 5) -> DataFrame:
    return inventory.reorder_profit(t.position, t.prices, top_n)


@question
def inventory_health(t: VisibleTables, months: int = 3) -> DataFrame:
    return inventory.inventory_health(t.inventory, t.items, t.prices, t.business, t.position, months)


@question
def overstock_items(t: VisibleTables, top_n: int = 3) -> DataFrame:
    return inventory.top_overstock(t.position, t.prices, top_n)


@question
def dead_stock(t: VisibleTables, top_n: int = 10) -> DataFrame:
    """Both readings in one answer: `kind` says never sold here, or hardly sold anywhere."""
    never = inventory.never_sold(t.inventory, t.sold, t.items, t.prices)
    quiet = inventory.recently_dead(t.inventory, t.sku_stats, t.prices)
    columns = [*PAIR, "family", "current_stock", "stock_value", "rank", "dead_items", "dead_value"]

    def part(df: DataFrame, kind: str) -> DataFrame:
        return inventory.dead_stock(df, top_n).select(F.lit(kind).alias("kind"), *columns)

    return part(never, "never sold here").unionByName(part(quiet, "recently dead"))


@question
def abc_analysis(t: VisibleTables, top_n: int | None = None) -> DataFrame:
    """Share per class, or the best items of each class when `top_n` is given."""
    classes = inventory.store_abc(t.sold, t.items, t.prices)
    return inventory.abc_summary(classes) if top_n is None else inventory.abc_top(classes, top_n)


@question
def weekly_pattern(t: VisibleTables, weeks: int = 12) -> DataFrame:
    return business.weekly_pattern(t.business, weeks)


@question
def family_mix_gap(t: VisibleTables) -> DataFrame:
    """The chain side counts every store; only visible stores are shown."""
    gaps = business.family_mix_extremes(business.family_mix_gap(t.all.sold, t.items, t.prices))
    return gaps.join(t.stores.select("store_nbr"), "store_nbr", "left_semi")


# ---------------------------------------------------------------- dashboard


@question
def kpi(t: VisibleTables, family: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    return dashboards.kpi(dashboards.forecast_filter(t.forecasts, t.items, None, family, low, high))


@question
def forecast_window(t: VisibleTables, as_of: date | None = None, family: str | None = None) -> DataFrame:
    """`as_of` is today unless given."""
    rows = dashboards.forecast_filter(t.forecasts, t.items, None, family)
    return dashboards.forecast_window(rows, as_of or F.current_date())


@question
def forecast_stores(t: VisibleTables) -> DataFrame:
    return dashboards.forecast_stores(t.forecasts)


@question
def families(t: VisibleTables) -> DataFrame:
    return dashboards.product_families(t.items)


@question
def stock(t: VisibleTables, item_nbr: int | None = None) -> DataFrame:
    return _of_item(t.inventory, item_nbr)


@question
def scenario_defaults(t: VisibleTables) -> DataFrame:
    """Values a scenario form starts from, per visible series."""
    whole = t.all
    past = scenario.history(
        whole.recent_sales(scenario.HISTORY_DAYS), t.stores, whole.items, whole.oil, whole.holidays,
        t.transactions, whole.origin,
    )
    return scenario.form_defaults(
        t.inventory, whole.items, whole.prices, t.planned_promotions, whole.oil, past, F.date_add(whole.origin, 1)
    )


@question
def daily_forecast(
    t: VisibleTables, family: str | None = None, low: str | None = None, high: str | None = None, days: int | None = None
) -> DataFrame:
    rows = dashboards.forecast_filter(t.forecasts, t.items, None, family, low, high)
    return dashboards.daily_forecast(rows, days)


@question
def products(t: VisibleTables, page: int = 1, page_size: int = 20, **filters) -> DataFrame:
    rows = dashboards.catalog(t.items, t.inventory, t.sold, t.sku_stats)
    return dashboards.catalog_page(rows, page, page_size, **filters)


@question
def low_stock(t: VisibleTables) -> DataFrame:
    return dashboards.low_stock_count(t.items, t.inventory)


@question
def top_products(t: VisibleTables, top_n: int = 8) -> DataFrame:
    return dashboards.top_products(t.sold, t.items, t.sku_stats, top_n)


@question
def family_mix(t: VisibleTables, top: int = 4) -> DataFrame:
    return dashboards.family_mix(t.sold, t.items, top)


@question
def family_trend(t: VisibleTables, days: int = 16, top: int = 6) -> DataFrame:
    return dashboards.family_trend(t.family_forecast, days, top)


@question
def business_history(t: VisibleTables) -> DataFrame:
    return aggregates.business_history(t.business, t.transactions)


@question
def recursive_forecast(t: VisibleTables) -> DataFrame:
    """Family forecast by the fitted local models."""
    future = t.all.future.join(t.stores.select("store_nbr"), "store_nbr", "left_semi")
    return forecast_recursive(t.panel, future, t.local_models)
