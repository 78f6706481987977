"""Streams of events: typed mapping, state folding, sessions, windowed counts and deduplication, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import window as W


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """File source; ``per_trigger`` bounds a batch, as back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def typed(events: DataFrame) -> DataFrame:
    """Rows as typed messages (kind, key, payload)."""
    kind = F.when(F.col("event_type") == "error", "RUN_ERROR").when(F.col("event_type") == "signup", "RUN_STARTED").when(F.col("event_type") == "purchase", "STATE_DELTA").otherwise("MESSAGE")
    return events.select("event_id", F.col("user_id").alias("key"), kind.alias("kind"), F.to_json(F.struct("event_type", "value")).alias("payload"), "ts")


def scope(key: Column) -> Column:
    """Scope of a state key by its prefix."""
    return F.when(F.startswith(key, F.lit("user:")), "user").when(F.startswith(key, F.lit("app:")), "app").when(F.startswith(key, F.lit("temp:")), "temp").otherwise("session")


def fold_state(deltas: DataFrame, thread: str, sequence: str, key: str, value: str) -> DataFrame:
    """Batch fold: the last non-null value of each (thread, key); temporary keys are never stored."""
    kept = deltas.where(~F.startswith(F.col(key), F.lit("temp:")) & F.col(value).isNotNull())
    return kept.groupBy(thread, key).agg(F.max_by(value, sequence).alias(value), F.max(sequence).alias("version")).withColumn("scope", scope(F.col(key)))


class _Fold(StatefulProcessor):
    """Last value and version of each (thread, key) by sequence; an expected version that differs counts as a conflict."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("value", "value string, version long, conflicts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, version, conflicts = self._value.get() if self._value.exists() else (None, -1, 0)
        for r in pd.concat(list(rows)).sort_values("sequence").itertuples():
            if r.sequence <= version:
                conflicts += 1
            elif r.value is not None:
                value, version = r.value, int(r.sequence)
        self._value.update((value, version, conflicts))
        yield pd.DataFrame({"thread": [key[0]], "key": [key[1]], "value": [value], "version": [version], "conflicts": [conflicts]})

    def close(self) -> None:
        pass


def fold_state_stream(deltas: DataFrame) -> DataFrame:
    """Streaming fold of (thread, key, sequence, value); needs the RocksDB state store."""
    return deltas.where(~F.startswith(F.col("key"), F.lit("temp:"))).groupBy("thread", "key").transformWithStateInPandas(_Fold(), "thread long, key string, value string, version long, conflicts long", "Update", "None")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key by gap, closed by the watermark; the same on a batch."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First of equal keys; on a stream, within the watermark, so the state is bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write what is there and stop: exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert_each_batch(stream: DataFrame, checkpoint: str, apply):
    """``apply(batch, epoch)`` for each micro-batch, for sinks with their own keys."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def rate_limited(calls: DataFrame, keys: list[str], time: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """``allowed``: fewer than ``limit`` calls of the keys in the ``seconds`` before (all calls count)."""
    w = W.Window.partitionBy(*keys).orderBy(F.unix_micros(time)).rangeBetween(-seconds * 1_000_000, -1)
    return calls.withColumn("allowed", F.count(F.lit(1)).over(w) < limit)


def fold_versions(changes: DataFrame) -> DataFrame:
    """Batch fold of versioned changes (thread, key, change, expected, value): each with its ``status`` and the ``version`` after it.

    A key's version starts at 0. Of the changes that expect one version the least ``change`` is applied, in unbroken order of
    versions from 0; the others are conflicts and leave the version that the key ends with.
    """
    rows = changes.where(F.col("expected").isNotNull())
    first = W.Window.partitionBy("thread", "key", "expected").orderBy("change")
    rows = rows.withColumn("n", F.row_number().over(first))
    heads = rows.where("n = 1").withColumn("place", F.row_number().over(W.Window.partitionBy("thread", "key").orderBy("expected")) - 1)
    applied = heads.where("place = expected").select("thread", "key", "change", F.lit(True).alias("applied"))
    ends = applied.groupBy("thread", "key").agg(F.count(F.lit(1)).alias("end"))
    out = rows.join(applied, ["thread", "key", "change"], "left").join(ends, ["thread", "key"], "left")
    hit = F.col("applied").isNotNull()
    return out.select("thread", "key", "change", "expected", "value", F.when(hit, "applied").otherwise("conflict").alias("status"), F.when(hit, F.col("expected") + 1).otherwise(F.coalesce("end", F.lit(0))).cast("long").alias("version"))


class _Versions(StatefulProcessor):
    """A key's version, and the changes that wait for theirs."""

    def __init__(self, retries: int) -> None:
        self._retries = retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._version = handle.getValueState("version", "version long, value string")
        self._waiting = handle.getListState("waiting", "change long, expected long, value string, tries int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, value = self._version.get() if self._version.exists() else (0, None)
        come = pd.concat(list(rows)).dropna(subset=["expected", "change"])
        open_ = [tuple(x) for x in self._waiting.get()] if self._waiting.exists() else []
        open_ += [(int(r.change), int(r.expected), r.value, 0) for r in come.itertuples()]
        open_.sort(key=lambda x: (x[1], x[0]))
        waiting, out = [], []
        for change, expected, new, tries in open_:
            if expected == version:
                version, value = version + 1, new
                out.append((change, expected, new, "applied", version))
            elif expected < version or tries >= self._retries:
                out.append((change, expected, new, "conflict", version))
            else:
                waiting.append((change, expected, new, tries + 1))
        self._version.update((version, value))
        self._waiting.clear()
        if waiting:
            self._waiting.put(waiting)
        told = pd.DataFrame(out, columns=["change", "expected", "value", "status", "version"])
        told.insert(0, "thread", key[0])
        told.insert(1, "key", key[1])
        yield told

    def close(self) -> None:
        pass


def fold_versions_stream(changes: DataFrame, retries: int = 3) -> DataFrame:
    """Streaming fold of (thread long, key string, change long, expected long, value string), each change told once when it is settled.

    A change whose expected version hasn't come waits; each time its key gets further changes it is tried again, and after
    ``retries`` tries it goes out as a conflict, as one that comes too late does. Rows without ``expected`` or ``change`` are left
    out. State: a version a key and the changes that wait. Needs the RocksDB state store.
    """
    schema = "thread long, key string, change long, expected long, value string, status string, version long"
    return changes.groupBy("thread", "key").transformWithStateInPandas(_Versions(retries), schema, "Update", "None")


class _Rate(StatefulProcessor):
    """Calls of a key in order of time, once the watermark has passed them; the last ``limit`` times decide."""

    def __init__(self, limit: int, seconds: int) -> None:
        self._limit, self._micros = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._recent = handle.getListState("recent", "t long")
        self._pending = handle.getListState("pending", "t long, call long")

    def _settle(self, key, pending: list[tuple[int, int]], mark: int) -> pd.DataFrame:
        recent = [x[0] for x in self._recent.get()] if self._recent.exists() else []
        ready = sorted(x for x in pending if x[0] < mark * 1000)
        out, held = [], []
        for t, call in ready:
            if held and held[0] != t:
                recent, held = (recent + held)[-self._limit :], []
            # as many as the limit before this time, all within the span: calls of one time don't count against each other
            full = len(recent) >= self._limit and recent[-self._limit] >= t - self._micros
            out.append((key[0], call, t, not full))
            held.append(t)
        recent = (recent + held)[-self._limit :]
        left = [x for x in pending if x[0] >= mark * 1000]
        for state, rows in ((self._recent, [(t,) for t in recent]), (self._pending, left)):
            state.clear()
            if rows:
                state.put(rows)
        for t in {x[0] // 1000 + 1 for x in left}:
            self._handle.registerTimer(t)
        return pd.DataFrame(out, columns=["key", "call", "t", "allowed"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending = [tuple(x) for x in self._pending.get()] if self._pending.exists() else []
        come = pd.concat(list(rows))
        pending += [(int(t), int(c)) for t, c in zip(come["t"], come["call"], strict=True)]
        yield self._settle(key, pending, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = [tuple(x) for x in self._pending.get()] if self._pending.exists() else []
        yield self._settle(key, pending, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def rate_limited_stream(calls: DataFrame, limit: int = 10, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Streaming ``rate_limited`` of (key string, call long, ts): (key, call, t in microseconds, allowed), told when the watermark passes.

    Calls that come late but within ``late`` count as if they had come in time. A key's state holds its last ``limit`` times and the
    calls that the watermark hasn't passed yet. Needs the RocksDB state store.
    """
    rows = calls.withWatermark("ts", late).select("key", "call", "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy("key").transformWithStateInPandas(_Rate(limit, seconds), "key string, call long, t long, allowed boolean", "Append", "EventTime")
