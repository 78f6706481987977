"""A left join whose frequent keys don't gather in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds at least this share of the rows is frequent; there can be no more than its inverse.
SHARE = 0.001


def left_join(rows: DataFrame, found: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the other columns of ``found`` (one row a key), null where there is none.

    ``count`` is a column of ``found``: how many of ``rows`` hold its key. Keys with SHARE of all rows or more, at most 1 / SHARE
    of them, are broadcast and their rows stay where they are; the others are shuffled. Both tables are read twice.
    """
    total = rows.count()
    hot = found.where(F.col(count) >= max(2, SHARE * total))
    cold = found.where(F.col(count) < max(2, SHARE * total))
    names = [c for c in found.columns if c not in keys and c != count]
    there = rows.join(F.broadcast(hot.select(*keys, *names)), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.select(*keys, *names), keys, "left")
    columns = [*rows.columns, *names]
    return there.select(*columns).unionByName(rest.select(*columns))
