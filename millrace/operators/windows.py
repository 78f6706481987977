"""Ordered logic per key: latest rows, sessions, streaks, budgets and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_n(rows: DataFrame, key: str, time: str, id_col: str, n: int) -> DataFrame:
    """Last n rows of each key; ``position`` ascends with time."""
    newest = W.Window.partitionBy(key).orderBy(F.desc(time), F.desc(id_col))
    kept = rows.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= n)
    return kept.withColumn("position", F.row_number().over(W.Window.partitionBy(key).orderBy(time, id_col))).drop("__r")


def sessions(rows: DataFrame, key: str, time: str, id_col: str, gap_seconds: float) -> DataFrame:
    """``session``: from 1, a new one after a gap of more than ``gap_seconds`` to the previous row."""
    order = W.Window.partitionBy(key).orderBy(time, id_col)
    new = (F.unix_micros(time) - F.lag(F.unix_micros(time)).over(order) > gap_seconds * 1_000_000).cast("int")
    return rows.withColumn("__new", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("__new").over(order)).drop("__new")


def complete_indices(rows: DataFrame, key: str, index: str, counted: Column) -> DataFrame:
    """Whether each key's distinct indices are exactly 0 to n - 1."""
    out = rows.where(counted).groupBy(key).agg(F.count_distinct(index).alias("n"), F.min(index).alias("low"), F.max(index).alias("high"))
    return out.select(key, "n", ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("complete"))


def failure_streak(rows: DataFrame, key: str, order: str, failed: Column, skipped: Column) -> DataFrame:
    """Failures since the last success, counted from the end; skipped rows neither count nor end the streak."""
    back = W.Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.Window.unboundedPreceding, 0)
    kept = rows.where(~skipped).withColumn("__ok", F.sum((~failed).cast("int")).over(back))
    return rows.select(key).distinct().join(kept.where("__ok = 0").groupBy(key).agg(F.count(F.lit(1)).alias("streak")), key, "left").fillna(0, ["streak"])


def no_progress(rows: DataFrame, key: str, order: str, score: str, patience: int) -> DataFrame:
    """Whether none of the last ``patience`` scores beats the best before them; false with too few scores."""
    scored = rows.where(F.col(score).isNotNull()).withColumn("__r", F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc(order))))
    out = scored.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("__r") <= patience, F.col(score))).alias("recent"), F.max(F.when(F.col("__r") > patience, F.col(score))).alias("before"))
    return out.select(key, F.coalesce((F.col("n") > patience) & (F.col("recent") <= F.col("before")), F.lit(False)).alias("stalled"))


def oscillating(rows: DataFrame, key: str, order: str, score: str, verdict: str) -> DataFrame:
    """Last four scored rows: no net gain, at least three verdicts given, at least two changes of verdict."""
    last = W.Window.partitionBy(key).orderBy(F.desc(order))
    kept = rows.where(F.col(score).isNotNull()).withColumn("__r", F.row_number().over(last)).where("__r <= 4")
    kept = kept.withColumn("__flip", F.coalesce((F.col(verdict) != F.lag(verdict).over(W.Window.partitionBy(key).orderBy(order))).cast("int"), F.lit(0)))
    out = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(verdict).alias("v"), F.sum("__flip").alias("flips"), F.max_by(score, order).alias("end"), F.min_by(score, order).alias("start"))
    return out.select(key, ((F.col("n") == 4) & (F.col("end") <= F.col("start")) & (F.col("v") >= 3) & (F.col("flips") >= 2)).alias("oscillating"))


def breaks(rows: DataFrame, key: str, order: str, similarity: Column) -> DataFrame:
    """``group``: from 0, a new one where a row is not similar to the one before (``similarity`` sees both)."""
    w = W.Window.partitionBy(key).orderBy(order)
    return rows.withColumn("group", F.sum(F.coalesce((~similarity).cast("int"), F.lit(0))).over(w))


def within_budget(rows: DataFrame, key: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Longest prefix of each key whose sizes sum to ``budget`` at most; stops at the first overflow."""
    w = W.Window.partitionBy(key).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    # sizes are not negative: once over the budget, the running sum stays over it
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def density_cap(rows: DataFrame, key: str, size: Column, score: str, position: str, least: int = 3, per: int = 200) -> DataFrame:
    """At most max(least, size / per) rows of a key, best score first, ties by position."""
    rank = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc(score), position))
    return rows.withColumn("__r", rank).where(F.col("__r") <= F.greatest(F.lit(least), F.floor(size / per))).drop("__r")


def segments(turns: DataFrame, key: str, order: str, text: Column, size: int = 5) -> DataFrame:
    """Runs of ``size`` turns, joined by newlines in order."""
    numbered = turns.withColumn("segment", F.floor((F.row_number().over(W.Window.partitionBy(key).orderBy(order)) - 1) / size))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return numbered.groupBy(key, "segment").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("content"))


def latest_values(rows: DataFrame, key: str, time: str, value: str, n: int = 3) -> DataFrame:
    """The last n values of each key, newest first, as a list."""
    kept = rows.withColumn("__r", F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc(time), F.desc(value)))).where(F.col("__r") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", value))), lambda x: x[value]).alias("latest"))


def reindex(rows: DataFrame, parent: str, *order: str, gap: int = 1000) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(W.Window.partitionBy(parent).orderBy(*order)) * gap)


def rate_in_window(rows: DataFrame, keys: list[str], time: str, seconds: int = 60) -> DataFrame:
    """Calls of the same keys within the last ``seconds``, this one included."""
    w = W.Window.partitionBy(*keys).orderBy(F.unix_micros(time)).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("recent_calls", F.count(F.lit(1)).over(w))


def keyset_page(rows: DataFrame, time: str, id_col: str, before: Column, before_id: int, n: int) -> DataFrame:
    """n + 1 rows that come after a cursor in (time desc, id desc); the extra one tells that there are more."""
    after = (F.col(time) < before) | ((F.col(time) == before) & (F.col(id_col) < before_id))
    return rows.where(after).orderBy(F.desc(time), F.desc(id_col)).limit(n + 1)


def latest_where(rows: DataFrame, key: str, order: list[str], status: str, wanted: list[str]) -> DataFrame:
    """The last row of each key by ``order``, if its status is one of ``wanted``: an earlier row that has it doesn't count."""
    last = W.Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n").where(F.col(status).isin(wanted))
