"""Cutting lineage with tables in the shared folder, and deciding on broadcasts by a checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows is broadcast; beyond it the planner shuffles.
BROADCAST_ROWS = 200_000


#: Spark deletes the shuffle files of a query once it has ended: the table holds its result.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes up to which rows go to Python in one Arrow batch, beside the bound on their number.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Folder of each table that ``materialize`` wrote.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Name in the catalog of each table that ``bucketed`` wrote.
_NAMES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Temporary folder of each application that runs in one process and has no ``spark.checkpoint.dir``.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset and all runs in one process, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table of a query's own; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, partition_by: list[str] | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike a local checkpoint the table survives the loss of executors; unlike a cache it is columnar on disk, so later reads
    prune columns. The table goes by ``free``, or when the driver's process ends. ``batch_bytes`` bounds the Arrow batches of long rows
    that Python functions in ``df`` get.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    wanted = {CLEANUP: "true"} | ({ARROW_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def bucketed(df: DataFrame, column: str, parts: int) -> DataFrame:
    """``materialize`` for a table that many joins on ``column`` follow: none of them shuffles it.

    ``df`` must lie in ``parts`` partitions by ``column``, as ``repartition(parts, column)`` deals it; they become the buckets.
    """
    spark = df.sparkSession
    name = f"millrace_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/millrace/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.format("parquet").bucketBy(parts, column).option("path", path).saveAsTable(name)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    atexit.register(_forget, spark, name)
    table = spark.table(name)
    _PATHS[table], _NAMES[table] = path, name
    return table


def _forget(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended, its catalog too
        pass


def free(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` or ``bucketed`` returned, once all that reads them has been written."""
    for table in tables:
        if name := _NAMES.pop(table, None):
            _forget(table.sparkSession, name)
        if path := _PATHS.pop(table, None):
            _remove(table.sparkSession, path)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` has ``limit`` rows at most (counted unless given); else leave the join to the planner."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it comes in fewer parts (a few small files); large inputs stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
