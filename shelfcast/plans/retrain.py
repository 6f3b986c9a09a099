"""The retrain job: train, forecast, split, then reload the serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.durable import cut
from shelfcast.operators import forecast
from shelfcast.operators.aggregates import sku_stats
from shelfcast.operators.clean import forward_fill, stack
from shelfcast.operators.features import extended_features
from shelfcast.operators.inventory import default_policy, derive_inventory
from shelfcast.operators.metrics import evaluate
from shelfcast.plans.serving import RetailTables
from shelfcast.sources.snapshots import Snapshot, Snapshots, Transaction


def combined_forecast(t: RetailTables) -> DataFrame:
    """Family forecast: the local model where its hold-out error is good, else the baseline."""
    local = forecast.forecast_recursive(t.panel, t.future, t.local_models).withColumnRenamed("prediction", "local")
    base = t.family_prediction.withColumnRenamed("prediction", "global")
    both = base.join(local.drop("horizon_day", "used_model"), ["store_nbr", "family", "date"], "left")
    routes = forecast.choose_routes(t.panel, t.local_scores, baseline_scores(t))
    usable = both.withColumn("local", F.coalesce("local", "global"))
    return forecast.routed_prediction(usable, routes, "local", "global")


def baseline_scores(t: RetailTables) -> DataFrame:
    """Error of the seasonal naive forecast per family over the same hold-out days."""
    rows = extended_features(t.panel.select("store_nbr", "family", "date", "target", "onpromotion"), 28)
    held = forecast.holdout_split(rows).filter("holdout")
    scored = held.withColumn("prediction", F.expm1(F.coalesce("slog_dow_mean4", F.lit(0.0))))
    return evaluate(scored, by=["family"])


def retrain(t: RetailTables, snapshots: Snapshots | None = None) -> Snapshot:
    """Run the whole job and commit forecasts, inventory and SKU stats together.

    Without `snapshots` they go where all later questions over these tables read them.  Nothing is
    committed when the forecast is empty or a step fails, so a failed run leaves the old tables.  The
    inventory starts anew from the new forecasts, also after restocks that came in meanwhile.
    """
    if t.plan.isEmpty():
        raise RuntimeError("the plan is empty; serving tables are left as they are")
    # a short table of known size by the time it meets the item plan
    predicted = cut(combined_forecast(t))
    items = forecast.split_to_items(t.shared_plan, t.items, predicted, t.shares)
    errors = t.local_scores.select("family", F.col("rmsle").alias("family_rmsle"))

    def reload(txn: Transaction) -> None:
        fresh = txn.write("forecasts", items)
        if fresh.isEmpty():
            raise RuntimeError("the forecast is empty; serving tables are left as they are")
        txn.write("inventory", derive_inventory(fresh, default_policy(fresh)))
        txn.write("sku_stats", sku_stats(t.sales, t.items, fresh, t.origin_date.year - 1, t.origin, errors))

    done = (snapshots or t.snapshots).commit(reload)
    t.refresh()
    return done


def history_with_future(t: RetailTables) -> DataFrame:
    """Panel and future rows in one frame, unknown traffic carried forward."""
    both = stack(t.panel, t.future)
    days = both.groupBy("store_nbr", "date").agg(F.max("transactions_lag1").alias("transactions_lag1"))
    filled = forward_fill(days, ["store_nbr"], ["transactions_lag1"])
    return both.drop("transactions_lag1").join(filled, ["store_nbr", "date"], "left")
