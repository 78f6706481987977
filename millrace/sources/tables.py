"""Readers of the bundled tables and of other sources, and writers with table semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.columns import col
from millrace.plans.materialize import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a schema is required."""
    return spark.read.schema(schema).json(path).dropna("all")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, kind) of whole text and Markdown files; the kind is the extension."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return found.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))


def replace_by_source(existing: DataFrame, new: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Rows of the sources in ``new`` are replaced by ``new``; sources must not be null."""
    touched = new.select(*keys, source).distinct()
    return existing.join(touched, [*keys, source], "left_anti").unionByName(new)


def delete_by_source(existing: DataFrame, source: str, value: str | None) -> DataFrame:
    """Delete the rows of one source; null deletes rows without one."""
    return existing.where(~col(source).eqNullSafe(F.lit(value)))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``; new rows win ties."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = W.Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__new", "__n")


def upsert_relations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Relations keyed by (source, target, type): the new weight and confidence win, validity reopens, observations add up."""
    keys = ["source", "target", "type"]
    fresh = new.groupBy(*keys).agg(F.max_by("weight", "seq").alias("w"), F.max_by("confidence", "seq").alias("c"), F.count(F.lit(1)).alias("seen"))
    both = existing.join(fresh, keys, "full_outer")
    hit = F.col("seen").isNotNull()
    return both.select(*keys, F.coalesce("w", "weight").alias("weight"), F.coalesce("c", "confidence").alias("confidence"), F.when(hit, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"), F.when(~hit, F.col("valid_to")).alias("valid_to"), (F.coalesce("observation_count", F.lit(0)) + F.coalesce("seen", F.lit(0))).alias("observation_count"))


def compare_and_set(existing: DataFrame, changes: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Status of each change (key, expected): applied with the next version, conflict, or missing."""
    both = changes.join(existing.select(key, version), key, "left")
    status = F.when(F.col(version).isNull(), "missing").when(F.col("expected").isNull() | (F.col("expected") == F.col(version)), "applied").otherwise("conflict")
    return both.select(key, "expected", status.alias("status"), F.when(status == "applied", F.col(version) + 1).otherwise(F.col(version)).alias("version"))


def dedup_by_hash(docs: DataFrame, content: Column | str, keys: list[str], order: str) -> DataFrame:
    """First row of each (keys, SHA-256 of the content), with the hash."""
    first = W.Window.partitionBy(*keys, "file_hash").orderBy(order)
    return docs.withColumn("file_hash", F.sha2(col(content), 256)).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def claim(rows: DataFrame, key: str, workers: int) -> DataFrame:
    """Deterministic assignment of due rows to workers by hash, in place of row locks."""
    return rows.withColumn("worker", F.pmod(F.crc32(col(key).cast("string")), F.lit(workers)).cast("int"))


def synthetic_items(spark: SparkSession, n: int, dim: int = 64, rare_share: float = 0.01, seed: int = 7) -> DataFrame:
    """Items with a rare user, random metadata and normal vectors, for benchmarks of selective search."""
    rare = F.rand(seed) < rare_share
    user = F.when(rare, "rare_user").otherwise(F.concat(F.lit("user_"), (F.rand(seed + 1) * 100).cast("int")))
    vector = F.array(*[F.randn(seed + 10 + i).cast("float") for i in range(dim)])
    metadata = F.to_json(F.struct((F.rand(seed + 2) * 5).cast("int").alias("priority"), F.when(F.rand(seed + 3) < 0.5, "open").otherwise("done").alias("status")))
    return spark.range(n).select("id", user.alias("user_id"), vector.alias("embedding"), metadata.alias("metadata"))


def archive_by_source(existing: DataFrame, source: str, value: str | None, flag: str = "archived") -> DataFrame:
    """Mark the rows of one source as archived; null marks rows without one."""
    return existing.withColumn(flag, F.coalesce(col(source).eqNullSafe(F.lit(value)) | col(flag), F.lit(False)))


def upsert_summaries(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """One summary for each (corpus, community, level), the last by ``order``; new rows win ties."""
    return upsert(existing, new, ["corpus", "community", "level"], order)


def append_in_batches(rows: DataFrame, order: str, size: int = 100) -> DataFrame:
    """Rows numbered by ``order`` with the batch each is written in; ranges of ``order`` are numbered apart, then moved by a running total."""
    parts = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts)
    place = F.row_number().over(W.Window.partitionBy("__part").orderBy(order)) - 1
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = parts.withColumn("__place", place).join(F.broadcast(starts), "__part").withColumn("row_no", F.col("__start") + F.col("__place"))
    return numbered.withColumn("batch", F.floor(F.col("row_no") / size)).drop("__part", "__place", "__start")
