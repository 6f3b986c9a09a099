"""Row-level access by store, applied where a table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AccessDenied(PermissionError):
    """The user may not see (all of) the stores asked for."""


def user_scope(access: DataFrame, user: str) -> DataFrame:
    return access.filter(F.col("username") == user).select("store_nbr").distinct()


def outside_scope(stores: DataFrame, access: DataFrame, user: str) -> DataFrame:
    """Stores asked for that the user may not see; empty means access is fine."""
    return stores.select("store_nbr").distinct().join(user_scope(access, user), "store_nbr", "left_anti")


def scope(
    df: DataFrame,
    access: DataFrame,
    user: str,
    admin: bool = False,
    store_nbr: int | None = None,
) -> DataFrame:
    """Rows of `df` the user may see.

    Administrators see every store.  A user without stores is refused rather than shown an
    unfiltered table, and so is a request for one store outside the scope.
    """
    wanted = df if store_nbr is None else df.filter(F.col("store_nbr") == store_nbr)
    if admin:
        return wanted
    allowed = user_scope(access, user)
    if allowed.isEmpty():
        raise AccessDenied(f"{user} has no store assigned")
    if store_nbr is not None and allowed.filter(F.col("store_nbr") == store_nbr).isEmpty():
        raise AccessDenied(f"{user} may not see store {store_nbr}")
    return wanted.join(allowed, "store_nbr", "left_semi")


def check_stores(stores: DataFrame, access: DataFrame, user: str, admin: bool = False) -> None:
    """Refuse a question unless every store it involves is inside the user's scope."""
    if not admin and not outside_scope(stores, access, user).isEmpty():
        raise AccessDenied(f"{user} may not see all stores of this question")


def scope_by_user(df: DataFrame, access: DataFrame) -> DataFrame:
    """Every user's view at once: one row per (user, visible row)."""
    return access.select("username", "store_nbr").distinct().join(df, "store_nbr")
