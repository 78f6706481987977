"""Sharding by longest-processing-time scheduling: rows that must stay together go to the least-loaded shard, largest group first."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from millrace.llm.columns import keeping
from millrace.llm.textbatch import trimmed
from millrace.plans.materialize import broadcast_if_small, free, materialize

#: Groups of one size that are numbered in one task.
SLICE = 100_000
#: A group of more rows than this, and than one in so many of all, is hot: such groups are this many at most.
HOT, MOST_HOT = 10_000, 100_000


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Schedule groups, given as (size, number of groups), largest first, each on the least-loaded shard (ties to the lower one).

    Yields (size, first, end, turn): of the groups of that size, number ``first + i`` goes to shard ``turn[i % len(turn)]``. Groups of
    one size are placed in cycles: the shards that a heap gives before the first of them comes up again take one each, and they
    take turns until the next shard's load is reached. So equal groups cost a few steps together, whatever their number.
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in sorted(sizes, reverse=True):
        first = 0
        while first < count:
            cycle = [heapq.heappop(heap)]
            low, lead = cycle[0]
            while heap and heap[0] < (low + size, lead):
                cycle.append(heapq.heappop(heap))
            turns = (count - first) // len(cycle)
            # full cycles before the next shard joins
            for load, s in heap[:]:
                above = load - low
                turns = min(turns, above // size - (above % size == 0 and s < lead)) if size else turns
            turn = [s for _, s in cycle]
            if turns:
                end = first + turns * len(cycle)
            else:
                end, turns = count, 1
                turn = turn[: count - first]
            yield size, first, end, turn
            for k, (load, s) in enumerate(cycle):
                heapq.heappush(heap, (load + (turns * size if k < len(turn) else 0), s))
            first = end


def _numbers(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """``groups`` with ``number``: the place by key among all groups of the same bytes. A class of many is numbered by slices of keys."""
    slices = classes.select("bytes", F.ceil(F.col("n_groups") / SLICE).cast("long").alias("slices")).where("slices > 1")
    head = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    cut = groups.join(broadcast_if_small(slices), "bytes", "left").withColumn("slice", F.floor(head * F.coalesce("slices", F.lit(1)) / F.lit(1 << 32)).cast("long"))
    within = F.row_number().over(W.Window.partitionBy("bytes", "slice").orderBy("key")) - 1
    before = W.Window.partitionBy("bytes").orderBy("slice").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = cut.where("slices > 1").groupBy("bytes", "slice").agg(F.count(F.lit(1)).alias("n_slice"))
    starts = materialize(counts.select("bytes", "slice", F.sum("n_slice").over(before).alias("start")))
    placed = cut.withColumn("within", within).join(broadcast_if_small(starts), ["bytes", "slice"], "left")
    return placed.select("key", "bytes", "n", (F.coalesce("start", F.lit(0)) + F.col("within")).alias("number"))


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their shard last; adds the task's number and the row's place among the task's rows of that shard."""
    task, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column(batch.num_columns - 1).to_numpy()
        place = np.empty(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s)
            place[mine] = seen.get(s, 0) + np.arange(len(mine))
            seen[s] = seen.get(s, 0) + len(mine)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), task, np.int32)), pa.array(place)], names=[*batch.schema.names, "__task", "__place"])


def shard(docs: DataFrame, shards: int, group: Column, size: Column, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (gapless in each shard, from 0) so that bytes are near equal and groups stay whole.

    ``group``: rows with an equal value stay together (null is a value of its own); ``size``: bytes of a row, null counts 0.
    ``keep``: columns of the result besides the new ones (all by default). New columns are named with ``prefix``.

    One rule at all sizes: every group, by bytes from the largest down and then by the SHA-256 of its value, goes to the least-loaded
    shard. The driver holds a count for each distinct number of bytes a group has, at most the square root of twice the total, and
    the turns that follow from it; groups and rows never pass through it. Wide rows are shuffled once, by group; rows of hot groups not
    at all. An empty table gives an empty result. Repeated rows each get their own slot.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    names = {x: f"{prefix}{x}" for x in ("shard", "slot")}
    if clash := {*names.values()} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    key = F.coalesce(F.unhex(F.sha2(group.cast("binary"), 256)), F.lit(b"").cast("binary"))
    rows = docs.select(*keep, key.alias("__key"), F.coalesce(size.cast("long"), F.lit(0)).alias("__size"))
    groups = materialize(rows.groupBy(F.col("__key").alias("key")).agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    classes = materialize(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    found = classes.select("bytes", "n_groups").toArrow()  # one row a distinct size
    turns = list(longest_first(zip(*(c.to_pylist() for c in found.columns), strict=True), shards))
    turns = pa.table([pa.array([t[k] for t in turns], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["bytes", "first", "end", "turn"])
    plan = spark.createDataFrame(turns).groupBy("bytes").agg(F.collect_list(F.struct("first", "end", "turn")).alias("turns"))
    numbered = _numbers(groups, classes).join(broadcast_if_small(plan, found.num_rows), "bytes")
    mine = F.filter("turns", lambda t: (t["first"] <= F.col("number")) & (F.col("number") < t["end"]))[0]
    where = F.get(mine["turn"], F.pmod(F.col("number") - mine["first"], F.size(mine["turn"])).cast("int"))
    placed = materialize(numbered.select(F.col("key").alias("__key"), "n", where.alias("__shard")))

    hot = F.broadcast(placed.where(F.col("n") > max(HOT, total // MOST_HOT)).select("__key", F.col("__shard").alias("__hot")))  # MOST_HOT at most
    marked = rows.drop("__size").join(hot, "__key", "left")
    some = marked.where(F.col("__hot").isNotNull()).select(*keep, F.col("__hot").alias("__shard"))
    rest = marked.where(F.col("__hot").isNull()).join(placed, "__key").select(*keep, "__shard")
    both = some.union(rest)
    schema = T.StructType([*both.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__place", T.LongType())])
    # each task numbers its own rows and the numbers are written down, so a task that runs again changes nothing
    counted = materialize(both.mapInArrow(trimmed(_count_slots), schema))
    before = W.Window.partitionBy("__shard").orderBy("__task").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counted.groupBy("__shard", "__task").agg(F.count(F.lit(1)).alias("__n")).select("__shard", "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    free(groups, classes, placed)
    out = counted.join(broadcast_if_small(starts), ["__shard", "__task"])
    return out.select(*keep, F.col("__shard").alias(names["shard"]), (F.col("__start") + F.col("__place")).cast("long").alias(names["slot"]))


@keeping("shard", "slot")
def shard_texts(docs: DataFrame, shards: int = 8, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Shard documents by text: a row counts its UTF-8 bytes plus 1 (null text: 1), equal texts stay together (null as empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return shard(docs, shards, body, F.octet_length(body) + 1, keep, prefix)
