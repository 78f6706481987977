"""Tables that are replaced and deleted by source, atomically: a reader sees all of a write or nothing of it.

Rows lie in ``data/version=<name>/source=<value>``. A manifest, itself a small table, tells for each source the version that holds
its rows; the file ``commits/<number>`` names the manifest of that commit. A write lays down its rows and its manifest first,
where no reader looks, and then creates the next commit's file, which only one writer can; a writer that comes second takes the
first one's manifest as its new base and tries the next number. A failed writer leaves rows that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.plans.materialize import broadcast_if_small

#: How often a writer takes a new base before it gives up.
TRIES = 20


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _commits(spark: SparkSession, path: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []


def _told(spark: SparkSession, path: str, number: int) -> tuple[str, str]:
    """Name of a commit's manifest, and the rows' schema as JSON (empty if nothing was ever written)."""
    fs, where = _fs(spark, f"{path}/commits/{number}")
    stream = fs.open(where)
    try:
        return stream.readUTF(), stream.readUTF()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, number: int, name: str, schema: str) -> bool:
    """Create the file of a commit; False if it exists."""
    fs, where = _fs(spark, f"{path}/commits/{number}")
    try:
        stream = fs.create(where, False)
    except Exception:
        if fs.exists(where):
            return False
        raise
    stream.writeUTF(name)
    stream.writeUTF(schema)
    stream.close()
    return True


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits, oldest first."""
    return _commits(spark, path)


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(source, version, rows) of a commit, the last by default."""
    number = max(_commits(spark, path), default=0) if number is None else number
    if number == 0:
        return spark.createDataFrame([], "source string, version string, rows long")
    return spark.read.schema("source string, version string, rows long").parquet(f"{path}/manifests/{_told(spark, path, number)[0]}")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of a commit. Partition columns prune: a filter on ``source`` reads its folders only.

    Only versions that hold some source's rows are listed; there are no more of them than commits.
    """
    number = max(_commits(spark, path), default=0) if number is None else number
    if number == 0:
        raise FileNotFoundError(f"no commit in {path}")
    listed = manifest(spark, path, number).select("source", "version")
    schema = StructType.fromJson(json.loads(_told(spark, path, number)[1]))
    versions_ = [r[0] for r in listed.select("version").distinct().collect()]
    if not versions_:
        return spark.createDataFrame([], schema).drop("version")
    found = _data(spark, f"{path}/data", [f"{path}/data/version={v}" for v in versions_], schema)
    return found.join(broadcast_if_small(listed), ["source", "version"]).drop("version")


def _data(spark: SparkSession, base: str, paths: list[str], schema: StructType) -> DataFrame:
    """Folders of data, with a stated schema: names of sources and versions stay strings, though they may look like numbers."""
    return spark.read.schema(schema).option("basePath", base).parquet(*paths)


def _commit(spark: SparkSession, path: str, touched: DataFrame, schema: StructType | None = None) -> int:
    """Publish ``touched`` (source, version, rows): these sources take these versions; those of no rows go."""
    for _ in range(TRIES):
        base = max(_commits(spark, path), default=0)
        kept = manifest(spark, path, base).join(touched, "source", "left_anti")
        name = uuid.uuid4().hex
        kept.unionByName(touched.where("rows > 0")).coalesce(1).write.parquet(f"{path}/manifests/{name}")
        told = schema.json() if schema is not None else _told(spark, path, base)[1]
        if _create(spark, path, base + 1, name, told):
            return base + 1
    raise RuntimeError(f"{TRIES} other writers came first")


def replace(rows: DataFrame, path: str, source: str, partition_by: list[str] | None = None, sources: DataFrame | None = None) -> tuple[int, int, int]:
    """Replace the rows of each source in ``rows`` (and in ``sources``, one column ``source``): (commit, rows that went, rows that came).

    A source named in ``sources`` that has no row in ``rows`` is deleted. Sources must be neither null nor empty: such a row is
    refused before anything is published. ``partition_by`` lays a source's rows out by further columns, the same ones for all
    writes to a table. An empty table of rows and sources
    changes nothing and gives the last commit.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    out = rows.withColumn("source", F.col(source).cast("string"))
    checked = out.withColumn("source", F.when(F.coalesce(F.col("source"), F.lit("")) == "", F.raise_error(F.lit("rows to replace need a source"))).otherwise(F.col("source")))
    schema = StructType([*out.schema.fields, StructField("version", StringType())])
    target = f"{path}/data/version={version}"
    checked.write.partitionBy("source", *(partition_by or [])).parquet(target)
    fs, where = _fs(spark, target)
    came = spark.createDataFrame([], "source string, rows long")
    if any(f.isDirectory() for f in fs.listStatus(where)):
        came = _data(spark, f"{path}/data", [target], schema).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    touched = came if sources is None else came.unionByName(sources.select(F.col("source").cast("string"), F.lit(0).cast("long").alias("rows")).dropna(subset=["source"]))
    touched = touched.groupBy("source").agg(F.sum("rows").alias("rows")).withColumn("version", F.lit(version)).select("source", "version", "rows")
    before = manifest(spark, path).join(touched.select("source"), "source", "left_semi").agg(F.sum("rows")).first()[0] or 0
    after = touched.agg(F.sum("rows")).first()[0]
    if after is None:
        return max(_commits(spark, path), default=0), 0, 0
    return _commit(spark, path, touched, schema), before, after


def delete(spark: SparkSession, path: str, values: list[str]) -> tuple[int, int]:
    """Delete the rows of the sources ``values``: (commit, rows that went)."""
    gone = spark.createDataFrame([(v, "", 0) for v in sorted({*values})], "source string, version string, rows long")
    if not _commits(spark, path):
        raise FileNotFoundError(f"no commit in {path}")
    went = manifest(spark, path).join(gone.select("source"), "source", "left_semi").agg(F.sum("rows")).first()[0] or 0
    return _commit(spark, path, gone), went
