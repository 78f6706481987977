"""A streaming source over an append-only event table, with offsets of its own: sequence numbers.

The table is a folder with one folder a batch, ``batch-<first>-<last>``, which appears by one rename with all its rows. A stream's
offset is the next sequence number to be read, kept in the query's checkpoint, so a restart neither loses nor repeats an event.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

#: What to do where sequence numbers are missing: wait for them, fail, or go on without them.
GAPS = ("wait", "fail", "skip")
#: Sequence numbers up to which neighbouring batches are read by one task.
TASK_EVENTS = 100_000


def append_events(events: DataFrame, path: str, sequence: str = "sequence_num") -> tuple[int, int] | None:
    """Add the events (of unbroken sequence numbers, each once) as one batch: its (first, last), or None if there is none.

    Numbers that repeat, break off or were written before are refused, and nothing is added.
    """
    spark = events.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    events.write.parquet(staged)
    first, last, n, distinct = spark.read.schema(events.schema).parquet(staged).agg(F.min(sequence), F.max(sequence), F.count(F.lit(1)), F.count_distinct(sequence)).first()
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(staged)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not n:
        files.delete(where, True)
        return None
    names = [s.getPath().getName() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(path))]
    taken = any(a <= last and first <= b for a, b, _ in _batches(names))
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/batch-{first:020d}-{last:020d}")
    if distinct != n or last - first + 1 != n or taken or not files.rename(where, target):
        files.delete(where, True)
        raise ValueError(f"sequence numbers {first} to {last}: {'written before' if taken else f'{distinct} of {n} rows'}")
    return first, last


def append_batches(events: DataFrame, path: str, batch: str, sequence: str = "sequence_num") -> list[tuple[int, int]]:
    """Add the events as one batch for each value of ``batch`` (a whole number), all written by one job: their (first, last), in order.

    Each batch appears by its own rename, the earliest first. If the numbers of any repeat, break off or were written before, all
    are refused and nothing is added.
    """
    spark = events.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    kept = [c for c in events.columns if c != batch]
    events.select(*kept, F.col(batch).cast("long").alias("__batch")).repartition("__batch").write.partitionBy("__batch").parquet(staged)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(staged)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not any(s.isDirectory() for s in files.listStatus(where)):
        files.delete(where, True)
        return []
    rows = spark.read.schema(StructType([*events.select(*kept).schema, StructField("__batch", LongType())])).parquet(staged)
    found = rows.groupBy("__batch").agg(F.min(sequence).alias("first"), F.max(sequence).alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct(sequence).alias("distinct"))
    told = sorted(tuple(r) for r in found.select("first", "last", "__batch", "n", "distinct").collect())  # a row for each folder
    before = _batches([s.getPath().getName() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(path))])
    spans = sorted([*((a, b) for a, b, _ in before), *((a, b) for a, b, *_ in told)])
    wrong = [(a, b) for a, b, key, n, distinct in told if key is None or distinct != n or b - a + 1 != n]
    wrong += [y for x, y in zip(spans, spans[1:], strict=False) if y[0] <= x[1]]
    done = []
    for first, last, key, *_ in [] if wrong else told:
        if not files.rename(jvm.org.apache.hadoop.fs.Path(f"{staged}/__batch={key}"), jvm.org.apache.hadoop.fs.Path(f"{path}/batch-{first:020d}-{last:020d}")):
            wrong = [(first, last)]
            break
        done.append((first, last))
    files.delete(where, True)
    if wrong:
        raise ValueError(f"sequence numbers {wrong[0][0]} to {wrong[0][1]} repeat, break off or were written before")
    return done


def _batches(names: list[str]) -> list[tuple[int, int, str]]:
    """(first, last, name) of the batches among the names, in order."""
    return sorted((int(m[1]), int(m[2]), n) for n in names if (m := re.fullmatch(r"batch-(\d+)-(\d+)", n)))


class _Span(InputPartition):
    def __init__(self, folders: list[str], first: int, end: int) -> None:
        self.folders, self.first, self.end = folders, first, end


class EventReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, start: int, gaps: str, sequence: str) -> None:
        if gaps not in GAPS:
            raise ValueError(f"gaps {gaps!r}; known: {', '.join(GAPS)}")
        self._names, self._path, self._start, self._gaps, self._sequence = schema.fieldNames(), path, start, gaps, sequence
        self._schema = schema
        self._reached = start

    def _listed(self) -> list[tuple[int, int, str]]:
        files, root = fs.FileSystem.from_uri(self._path)
        return _batches([f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory])

    def initialOffset(self) -> dict:
        return {"next": self._start}

    def latestOffset(self) -> dict:
        """Behind the last event that can be reached from the first without a gap, unless gaps are skipped."""
        reached = self._start
        for first, last, _ in self._listed():
            if first > reached and self._gaps == "fail":
                raise ValueError(f"events {reached} to {first - 1} are missing")
            if first > reached and self._gaps == "wait" and reached >= self._reached:
                break
            reached = max(reached, last + 1)
        self._reached = max(self._reached, reached)
        return {"next": self._reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["next"], end["next"]
        spans: list[_Span] = []
        for first, last, name in self._listed():
            if first >= high or last < low:
                continue
            if spans and min(high, last + 1) - spans[-1].first <= TASK_EVENTS:  # small batches share a task
                spans[-1].folders.append(name)
                spans[-1].end = min(high, last + 1)
            else:
                spans.append(_Span([name], max(low, first), min(high, last + 1)))
        return spans

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(self._path)
        wanted = (pc.field(self._sequence) >= partition.first) & (pc.field(self._sequence) < partition.end)
        for folder in partition.folders:
            rows = ds.dataset(f"{root}/{folder}", filesystem=files, format="parquet", exclude_invalid_files=False)
            yield from rows.to_batches(columns=self._names, filter=wanted)

    def commit(self, end: dict) -> None:
        """Offsets are kept in the checkpoint; the table itself is never changed by a reader."""


class EventTable(DataSource):
    """``spark.readStream.format("event_table")``; options ``path`` (a URI that pyarrow opens), ``start``, ``gaps``, ``sequence``."""

    @classmethod
    def name(cls) -> str:
        return "event_table"

    def schema(self) -> str:
        raise ValueError("give the events' schema")

    def streamReader(self, schema: StructType) -> EventReader:
        o = self.options
        return EventReader(schema, o["path"], int(o.get("start", "0")), o.get("gaps", "wait"), o.get("sequence", "sequence_num"))


def read_event_table(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    """The events as a stream, each once and in batches of unbroken sequence numbers."""
    spark.dataSource.register(EventTable)
    return spark.readStream.format("event_table").schema(schema).options(path=path, **options).load()
