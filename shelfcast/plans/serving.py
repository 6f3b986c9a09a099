"""Serving tables: derived once from the facts, then read by every question.

Tables go to the cluster's shared folder under the application's own name, so they outlive
lost executors and never leak between runs; `RetailTables(..., root=...)` keeps them at a
path of the caller's choice instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.constants import HORIZON_DAYS, SHARE_LOOKBACK_DAYS
from shelfcast.functions.durable import shared_dir
from shelfcast.operators import aggregates, clean, forecast, inventory, panel
from shelfcast.operators.enrich import with_item_columns
from shelfcast.sources.raw import between, ingest_sales, store_by_month
from shelfcast.sources.snapshots import Snapshot, Snapshots
from shelfcast.sources.tables import materialize, newest_partition, path_exists
from shelfcast.sources.testdata import OrderTables

SALES_COLUMNS = ["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"]


class RetailTables:
    """Lazily built tables over one input folder; `force` rebuilds each on first use."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        root: str | None = None,
        horizon: int = HORIZON_DAYS,
        force: bool = False,
    ):
        self.spark = spark
        self.source = OrderTables(spark, folder)
        self.horizon = horizon
        self.force = force
        tag = hashlib.sha256(folder.encode()).hexdigest()[:12]
        self.root = root or f"{shared_dir(spark)}/shelfcast-{spark.sparkContext.applicationId}/{tag}"

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return materialize(self.spark, build, f"{self.root}/{name}", self.force)

    # ---- published states take the place of what is derived here

    @property
    def published_root(self) -> str:
        return f"{self.root}/published"

    @property
    def snapshots(self) -> Snapshots:
        return Snapshots(self.spark, self.published_root)

    @cached_property
    def snapshot(self) -> Snapshot:
        """The published tables these ones read, all of one commit, until `refresh`."""
        return self.snapshots.latest()

    def served(self, name: str, build: Callable[[], DataFrame], *sources: str) -> DataFrame:
        """The published state of a table, or the stored one for the states of its `sources`."""
        if name in self.snapshot:
            return self.snapshot.read(name)
        made_from = [self.snapshot.tables[s] for s in sources if s in self.snapshot]
        return self.stored("@".join([name, *made_from]), build)

    def refresh(self, snapshot: Snapshot | None = None) -> None:
        """Read the newest published tables, or those of `snapshot`."""
        for name in ("snapshot", "forecasts", "family_forecast", "inventory", "position", "sku_stats"):
            self.__dict__.pop(name, None)
        if snapshot is not None:
            self.__dict__["snapshot"] = snapshot

    # ---- dimensions and raw facts (lazy)

    @cached_property
    def stores(self) -> DataFrame:
        return self.source.stores

    @cached_property
    def items(self) -> DataFrame:
        return self.source.items

    @cached_property
    def prices(self) -> DataFrame:
        return self.source.prices

    @cached_property
    def holidays(self) -> DataFrame:
        return clean.prepare_holidays(self.source.holidays)

    @cached_property
    def access(self) -> DataFrame:
        return self.source.access

    @property
    def _sales_path(self) -> str:
        return f"{self.root}/sales_by_month"

    @cached_property
    def origin_date(self) -> date:
        """Last day of history: the horizon before the newest sale.

        One value to the driver, so that scans get a literal they can prune with; it is read
        from the newest month alone.
        """
        sales = self._sales_by_month
        month = newest_partition(self.spark, self._sales_path, "month")
        rows = sales.filter(F.col("month") == month)
        return rows.agg(F.max("date")).first()[0] - timedelta(days=self.horizon)

    @property
    def origin(self) -> Column:
        return F.lit(self.origin_date)

    @cached_property
    def _sales_by_month(self) -> DataFrame:
        """All sales with store, family and perishable flag, joined once, laid out by month."""
        rows = with_item_columns(self.source.raw_sales, self.items, "family", "perishable")
        path = self._sales_path
        if self.force or not path_exists(self.spark, f"{path}/_SUCCESS"):
            store_by_month(rows, path)
        # the month stays text: inferring it from folder names would make it a date
        return self.spark.read.schema(rows.schema.add("month", "string")).parquet(path)

    @property
    def raw_sales(self) -> DataFrame:
        return self._sales_by_month.select(*SALES_COLUMNS)

    @property
    def raw_family_history(self) -> DataFrame:
        return between(self._sales_by_month, None, self.origin_date).drop("month")

    @property
    def raw_history(self) -> DataFrame:
        return self.raw_family_history.select(*SALES_COLUMNS)

    @property
    def family_sales(self) -> DataFrame:
        """Cleaned sales history up to the forecast origin, with family and perishable flag."""
        return ingest_sales(self.raw_family_history)

    @property
    def sales(self) -> DataFrame:
        return self.family_sales.select(*SALES_COLUMNS)

    def recent_sales(self, days: int) -> DataFrame:
        """Cleaned sales of the origin and the `days` days before it, with family columns."""
        first = self.origin_date - timedelta(days=days)
        return ingest_sales(between(self._sales_by_month, first, self.origin_date)).drop("month")

    @property
    def later_sales(self) -> DataFrame:
        """What was really sold over the horizon."""
        first = self.origin_date + timedelta(days=1)
        return between(self._sales_by_month, first, None).select(*SALES_COLUMNS)

    @cached_property
    def transactions(self) -> DataFrame:
        return self.stored(
            "transactions", lambda: self.source.transactions.filter(F.col("date") <= self.origin)
        )

    @cached_property
    def oil(self) -> DataFrame:
        """Gap-free oil price over every day of history and horizon."""
        raw = self.source.oil
        low = raw.agg(F.min("date")).scalar()
        high = F.date_add(self.origin, self.horizon)
        return self.stored("oil", lambda: clean.fill_daily(raw, "dcoilwtico", "oil_price", low, high))

    # ---- small aggregates

    @cached_property
    def sold(self) -> DataFrame:
        return self.stored("item_store_sales", lambda: aggregates.item_store_sales(self.sales))

    @cached_property
    def cube(self) -> DataFrame:
        """Rows and units per day, store, family, perishable and promotion flag."""
        return self.stored("daily_cube", lambda: aggregates.daily_cube(self.family_sales, self.items))

    @cached_property
    def business(self) -> DataFrame:
        return self.stored(
            "daily_business", lambda: aggregates.business_of(self.cube, self.prices)
        )

    @cached_property
    def promo_stats(self) -> DataFrame:
        return self.stored("promo_family_stats", lambda: aggregates.promotions_of(self.cube))

    @cached_property
    def history(self) -> DataFrame:
        """Units by day, family and perishable flag."""
        return self.stored("family_history", lambda: aggregates.history_of(self.cube))

    # ---- panel and forecasts

    @cached_property
    def family_panel(self) -> DataFrame:
        return self.stored(
            "family_panel",
            lambda: panel.build_family_panel(
                self.raw_family_history, self.stores, self.items, self.oil, self.holidays, self.transactions
            ),
        )

    @cached_property
    def panel(self) -> DataFrame:
        return self.stored("panel", lambda: panel.complete_panel(self.family_panel, check=False))

    @cached_property
    def planned_pairs(self) -> DataFrame:
        """Every pair ever sold, from the sums per pair: no pass over the facts.

        Stored as pairs; what is read by day is spread when it is read, so nothing that joins by store
        and item alone moves a pair once for every day of the horizon.
        """
        return self.stored(
            "planned_pairs",
            lambda: forecast.number_pairs(forecast.planned_pairs(self.sold, self.later_sales)),
        )

    @cached_property
    def planned_items(self) -> DataFrame:
        """Planned pairs with family and perishable flag of their items."""
        return self.stored(
            "planned_items", lambda: with_item_columns(self.planned_pairs, self.items, "family", "perishable")
        )

    @cached_property
    def shared_pairs(self) -> DataFrame:
        """Planned pairs with their family and their share in it: the item forecast but for the days."""
        return self.stored(
            "shared_pairs",
            lambda: forecast.with_shares(self.planned_items.drop("promos", "perishable"), self.shares),
        )

    def by_day(self, pairs: DataFrame) -> DataFrame:
        """Planned pairs spread over the horizon."""
        return forecast.plan_days(pairs, self.origin, self.horizon)

    @cached_property
    def plan(self) -> DataFrame:
        return self.by_day(self.planned_pairs).select("date", "store_nbr", "item_nbr", "onpromotion", "id")

    @property
    def family_plan(self) -> DataFrame:
        """The plan with family and perishable flag of the items."""
        return self.by_day(self.planned_items)

    @property
    def shared_plan(self) -> DataFrame:
        """The plan with family and share of the items, as the item split reads it."""
        return self.by_day(self.shared_pairs)

    @cached_property
    def shares(self) -> DataFrame:
        return self.stored(
            "item_shares",
            lambda: aggregates.item_shares(
                self.recent_sales(SHARE_LOOKBACK_DAYS), self.items, self.origin
            ),
        )

    @cached_property
    def family_prediction(self) -> DataFrame:
        """Seasonal naive forecast per series, the baseline every question runs on."""
        return self.stored(
            "family_prediction",
            lambda: forecast.seasonal_naive(self.panel, forecast.future_series(self.panel, self.horizon)),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """The published item forecast, or the split of the baseline, which is made from stored pairs when read."""
        if "forecasts" in self.snapshot:
            return self.snapshot.read("forecasts")
        return forecast.split_to_items(self.shared_plan, self.items, self.family_prediction, self.shares)

    @property
    def forecasts_in_order(self) -> DataFrame:
        """The item forecast in the order of its ids."""
        if "forecasts" in self.snapshot:
            return self.forecasts.orderBy("id")
        return forecast.split_in_order(self.shared_pairs, self.items, self.family_prediction, self.shares, self.origin, self.horizon)

    @property
    def forecast_totals(self) -> DataFrame:
        """The item forecast for sums per pair or item: over the days already, with `n_days`, unless it is published."""
        if "forecasts" in self.snapshot:
            return self.forecasts
        return forecast.split_totals(self.shared_pairs, self.family_prediction, self.origin, self.horizon)

    @property
    def forecast_days(self) -> DataFrame:
        """The item forecast for sums per store or day: over the items of a family already, unless it is published."""
        if "forecasts" in self.snapshot:
            return self.forecasts
        return forecast.split_days(self.shared_pairs, self.family_prediction, self.origin, self.horizon)

    @property
    def forecasts_of_families(self) -> DataFrame:
        """The item forecast next to the family of its item, summed over the items unless it is published."""
        names = self.items.select("item_nbr", "family")
        if "forecasts" in self.snapshot:
            return self.forecasts.join(names, "item_nbr")
        named = self.shared_pairs.join(names.withColumnRenamed("family", "_family"), "item_nbr")
        rows = forecast.split_days(named, self.family_prediction, self.origin, self.horizon, ("_family",))
        return rows.drop("family").withColumnRenamed("_family", "family")

    @property
    def forecast_pairs(self) -> DataFrame:
        """The pairs of the item forecast, which may repeat."""
        return self.forecasts.select("store_nbr", "item_nbr") if "forecasts" in self.snapshot else self.planned_pairs

    @cached_property
    def family_forecast(self) -> DataFrame:
        return self.served(
            "forecast_by_family",
            lambda: aggregates.forecast_by_family(self.forecasts_of_families, self.items),
            "forecasts",
        )

    @cached_property
    def inventory(self) -> DataFrame:
        return self.served(
            "inventory",
            lambda: inventory.derive_inventory(self.forecast_totals, inventory.default_policy(self.forecast_pairs)),
            "forecasts",
        )

    @cached_property
    def position(self) -> DataFrame:
        return self.served(
            "position", lambda: inventory.position(self.forecast_totals, self.inventory, self.items), "forecasts", "inventory"
        )

    @cached_property
    def sku_stats(self) -> DataFrame:
        return self.served(
            "sku_stats",
            lambda: aggregates.sku_stats(
                self.sales, self.items, self.forecast_totals, self.origin_date.year - 1, self.origin
            ),
            "forecasts",
        )

    @cached_property
    def planned_promotions(self) -> DataFrame:
        return self.stored(
            "planned_promotions", lambda: aggregates.future_promotions(self.family_plan, self.items)
        )

    @cached_property
    def _local(self) -> tuple[DataFrame, DataFrame]:
        return forecast.train_local(self.panel)

    @cached_property
    def local_models(self) -> DataFrame:
        return self.stored("local_models", lambda: self._local[0])

    @cached_property
    def driver_models(self) -> DataFrame:
        return self.stored("driver_models", lambda: forecast.train_drivers(self.panel, self.local_models))

    @cached_property
    def local_scores(self) -> DataFrame:
        return self.stored("local_scores", lambda: self._local[1])

    @cached_property
    def future(self) -> DataFrame:
        """Future panel rows with drivers, from the plan."""
        return self.stored(
            "future",
            lambda: panel.future_rows(forecast.plan_families(self.planned_items, self.origin, self.horizon), self.stores, self.oil, self.holidays),
        )


_OPEN: dict[tuple[str, str], RetailTables] = {}


def tables(spark: SparkSession, folder: str) -> RetailTables:
    """The application's tables over one folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = RetailTables(spark, folder)
    return _OPEN[key]
