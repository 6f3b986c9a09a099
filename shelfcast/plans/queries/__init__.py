"""Importing this package registers every query."""

from shelfcast.plans.queries import (  # noqa: F401
    aggregates,
    features,
    forecasting,
    inventory,
    scenarios,
    scoring,
    sources,
    stores,
    text,
)
