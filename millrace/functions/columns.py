"""Small helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(c)))


def days_between(now: Column, then: Column | str) -> Column:
    """Days with fractions, from microseconds; ``now`` is always a parameter."""
    return (F.unix_micros(now) - F.unix_micros(col(then))) / F.lit(86_400_000_000.0)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, ``empty`` where b is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float(empty)))


def lookup(key: Column | str, table: dict[str, float], default: float) -> Column:
    """Value of a small fixed table by key."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(col(key), F.lit(""))), F.lit(float(default)))
