"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str], who: str) -> None:
    """Raise with the missing names when `df` lacks a required column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{who}: missing columns {missing}")


def clipped(col: Column | str, low: float = 0.0) -> Column:
    """Value with a floor; a null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c < low, F.lit(low)).otherwise(c)


def log_target(col: Column | str) -> Column:
    return F.log1p(clipped(col))


def unlog_target(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return clipped(F.expm1(c))


def finite(col: Column | str) -> Column:
    """Null for NaN and the infinities."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """`num / den`, or `empty` where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(empty).cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    """Percent change; null when the old value is not positive."""
    return ratio((new - old) * 100.0, old)


def month_key(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM")


def check_number(value: float, name: str, low: float = 0.0) -> float:
    """Reject parameters that are not finite or lie below `low`."""
    number = float(value)
    if number != number or number in (float("inf"), float("-inf")) or number < low:
        raise ValueError(f"{name} must be a finite number >= {low}, got {value!r}")
    return number


def check_count(value: int, name: str, low: int = 1) -> int:
    """A whole number of at least `low`; nothing is cut to an upper bound."""
    number = int(value)
    if number != value or number < low:
        raise ValueError(f"{name} must be a whole number >= {low}, got {value!r}")
    return number


def grade(col: Column | str, digits: int = 6) -> Column:
    """Value on a decimal grid, so that sums added in different orders compare and rank alike.

    The offset lies off the decimal ties, where sums of money and shares often end.  From
    2**53 / 10**digits on, neighbouring doubles lie farther apart than the grid, so each is its own.
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10**digits)
    snapped = F.floor(c * scale + 0.50003).cast("double") / scale
    return F.when(F.abs(c) < 2.0**53 / scale, snapped).otherwise(c)
