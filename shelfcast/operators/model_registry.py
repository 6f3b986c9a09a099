"""Models kept with what they expect and what they answered.

A saved model is one commit of a log of manifests: its tables, its input (feature names and types, in order, with a
digest), and a sample of rows with the predictions it made when it was saved.  Loading refuses another input,
and scores the sample again: a model whose answers have changed is refused too.  So a model is there whole or not
at all, and code that builds other features can't use it unnoticed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import FEATURE_SPEC_VERSION
from shelfcast.sources.snapshots import Snapshot, Snapshots, Transaction

SAMPLE_ROWS = 200
TOLERANCE = 1e-9
# adds `prediction` to feature rows, from the model's tables and numbers
Scorer = Callable[[DataFrame, dict[str, DataFrame], dict], DataFrame]


class ModelMismatch(ValueError):
    """The model was saved for other inputs, or answers differently now."""


def input_of(rows: DataFrame, features: list[str]) -> dict:
    """What a model reads: names and types in order, the version of the feature code, and their digest."""
    kinds = dict(rows.dtypes)
    said = {"features": [[f, kinds[f]] for f in features], "version": FEATURE_SPEC_VERSION}
    return said | {"digest": hashlib.sha256(json.dumps(said).encode()).hexdigest()}


def save_model(log: Snapshots, name: str, tables: dict[str, DataFrame], numbers: dict, rows: DataFrame, features: list[str], keys: list[str], score: Scorer, sample: int = SAMPLE_ROWS) -> Snapshot:
    """Save a model's `tables` and `numbers`, with the answers to `sample` of `rows` (those of the smallest key hash)."""

    def build(txn: Transaction) -> None:
        kept = {k: txn.write(f"{name}.{k}", df) for k, df in tables.items()}
        some = rows.select(*keys, *features).orderBy(F.xxhash64(*keys), *keys).limit(sample)
        held = txn.write(f"{name}:input", some)
        txn.write(f"{name}:sample", score(held, kept, numbers).select(*keys, *features, "prediction"))
        said = {"input": input_of(held, features), "numbers": numbers, "tables": sorted(tables), "keys": keys}
        txn.write(f"{name}:meta", log.spark.createDataFrame([(json.dumps(said),)], "value string"))

    return log.commit(build)


def load_model(log: Snapshots, name: str, features: list[str], score: Scorer, rows: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict]:
    """A model's tables and numbers, after its input was compared with `features` (and the types of `rows`, if
    given) and its sample was scored again."""
    now = log.latest()
    if f"{name}:meta" not in now:
        raise KeyError(f"no model {name!r} under {log.root}")
    said = json.loads(now.read(f"{name}:meta").first()["value"])
    sample = now.read(f"{name}:sample")
    wanted = input_of(sample if rows is None else rows, features) if set(features) <= set((sample if rows is None else rows).columns) else None
    if wanted is None or wanted["digest"] != said["input"]["digest"]:
        raise ModelMismatch(f"model {name!r} reads {said['input']['features']} of version {said['input']['version']}")
    tables = {k: now.read(f"{name}.{k}") for k in said["tables"]}
    again = score(sample.withColumnRenamed("prediction", "_before"), tables, said["numbers"])
    away = again.filter(~(F.abs(F.col("prediction") - F.col("_before")) <= TOLERANCE * (1 + F.abs("_before"))) | F.col("prediction").isNull())
    if not away.isEmpty():
        raise ModelMismatch(f"model {name!r} no longer gives the answers it was saved with")
    return tables, said["numbers"]
