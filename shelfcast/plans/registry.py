"""Registered queries: a name, the inventory ids it covers, a plan and an equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.expr import grade
from shelfcast.plans.serving import RetailTables, tables
from shelfcast.plans.views import VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[RetailTables], DataFrame]
    sql: str | None
    digits: int = 6

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return settle(self.build(tables(spark, folder)), self.digits)


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, digits: int = 6):
    """Register a plan under `name`; `covers` lists inventory ids separated by spaces."""

    def register(build: Callable[[RetailTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), build, sql and with_views(sql), digits)
        return build

    return register


def settle(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form of a result: doubles on a decimal grid (see `grade`), days as ISO text."""

    def form(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return grade(c, digits).alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        return c

    return df.select(*[form(f) for f in df.schema.fields])


def r(expr: str, digits: int = 6) -> str:
    """The SQL twin of `settle` for one double."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{digits} + 0.50003) / 1e{digits})"


def d(expr: str) -> str:
    """The SQL twin of `settle` for one day."""
    return f"strftime({expr}, '%Y-%m-%d')"


def with_views(body: str) -> str:
    """Prefix a SQL body with the views it names, and the ones those need."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bv_[a-z0-9_]+\b", text)):
            if word not in needed and word in VIEWS:
                visit(VIEWS[word])
                needed.append(word)

    visit(body)
    if not needed:
        return body.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    head = body.strip()
    if head.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{head[15:]}"
    if head.upper().startswith("WITH "):
        return f"WITH {views},\n{head[5:]}"
    return f"WITH {views}\n{head}"
