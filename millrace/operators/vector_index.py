"""Vector search over a stored inverted-file index: vectors by the cell of their nearest centroid, filters inside the cells.

Centroids are fitted by spherical k-means on a bounded sample; every vector is indexed. The index is a versioned table partitioned by
source and cell, so a source is replaced atomically and a query reads the folders of the cells it probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.sources import versioned

#: Vectors of the sample that centroids are fitted on, cells at most, and vectors of a cell that one task scores at once.
SAMPLE, CELLS, BLOCK = 20_000, 4096, 8192


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: str, dim: int) -> Column:
    """A vector of ``dim`` finite components that aren't all zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def fit(items: DataFrame, dim: int, id_col: str = "id", vector: str = "embedding", cells: int | None = None, rounds: int = 12) -> np.ndarray:
    """Centroids, one a row: k-means by cosine on the SAMPLE usable vectors with the least hash of the id.

    As many cells as the square root of the number of vectors, but no more than CELLS, unless given.
    """
    good = items.where(usable(vector, dim))
    n = good.count()
    cells = min(CELLS, max(1, round(n**0.5))) if cells is None else cells
    sample = good.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(F.col(vector).cast("array<double>").alias("v"))
    x = _unit(np.array([r[0] for r in sample.collect()], float).reshape(-1, dim))
    centers = x[np.random.default_rng(1).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centers)) > 0
        centers[held] = _unit(sums[held])
    return centers


def assign(items: DataFrame, centers: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``items`` with usable vectors, and their ``cell`` and cosine with its centroid, ``near``; others have no place in an index."""
    dim = centers.shape[1]
    good = items.where(usable(vector, dim))
    place = good.schema.names.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _unit(_matrix(batch.column(place))) @ centers.T
            cell = score.argmax(1) if len(score) else np.zeros(0, int)
            near = score[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in good.schema)
    return good.mapInArrow(run, f"{fields}cell int, near double")


def write_index(items: DataFrame, path: str, dim: int, source: Column | None = None, id_col: str = "id", vector: str = "embedding", cells: int | None = None) -> tuple[int, int, int]:
    """Put the items' sources into the index at ``path`` (the first write fits its centroids): (commit, vectors out, vectors in)."""
    spark = items.sparkSession
    if not versioned.versions(spark, path):
        centers = fit(items, dim, id_col, vector, cells)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    rows = assign(items.withColumn("index_source", F.lit("all") if source is None else source), centroids(spark, path), vector)
    return versioned.replace(rows.repartition("index_source", "cell"), path, "index_source", ["cell"])


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    """At most CELLS rows, sent to every task."""
    return np.array([r[0] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").select("centroid").collect()], float)


def _cells(rows: DataFrame) -> dict[int, tuple[int, float]]:
    """Of each cell the rows that pass the filter and the least cosine with its centroid: two narrow columns of the index."""
    found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect()
    return {r.cell: (r.n, r.near) for r in found}


def probes(queries: DataFrame, centers: np.ndarray, cells: dict[int, tuple[int, float]], least: int, at_least: int = 1) -> DataFrame:
    """(query_id, cell, place, bound): the cells of each query (query_id, vector), best centroid first, until they hold ``least`` rows.

    ``cells`` counts rows that pass the filter, so a selective filter makes a query look into more cells, at last into all.
    ``bound`` is the highest cosine that a row of the cell can have, by the angles to the centroid.
    """
    order = sorted(cells)
    n, near = np.array([cells[c][0] for c in order]), np.array([cells[c][1] for c in order])
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _unit(_matrix(batch.column(1))) @ centers[order].T
            turn = np.argsort(-score, axis=1, kind="stable")
            before = np.cumsum(n[turn], axis=1) - n[turn]
            take = (before < least) | (np.arange(len(order)) < at_least)
            i, place = np.nonzero(take)
            cell = turn[i, place]
            angle = np.arccos(np.clip(score[i, cell], -1, 1)) - np.arccos(np.clip(near[cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(np.array(order, np.int32)[cell]), pa.array(place.astype(np.int32)), pa.array(np.cos(np.maximum(angle, 0)) + 1e-9)], names=["query_id", "cell", "place", "bound"])

    return queries.select("query_id", F.col("vector").cast("array<double>")).mapInArrow(run, f"query_id {kind}, cell int, place int, bound double")


def _score(rows: DataFrame, asked: DataFrame, k: int, cells: dict[int, tuple[int, float]], id_col: str, vector: str) -> DataFrame:
    """(query_id, id, score, rank) of the k best of each query among the rows of its cells; ``asked``: (query_id, vector, cell).

    A cell's rows are dealt to blocks of about BLOCK, each of which meets the cell's queries once, in matrix products.
    """
    spark = rows.sparkSession
    blocks = spark.createDataFrame([(c, -(-n // BLOCK)) for c, (n, _) in cells.items()], "cell int, blocks int")
    items = rows.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64(id_col), "blocks").cast("int").alias("block"), F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = asked.join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", F.col("vector").cast("array<double>").alias("q"))
    kind, qkind = items.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        left, right = left.combine_chunks(), right.combine_chunks()
        if len(left) and len(right):
            x = _unit(_matrix(left["v"].chunk(0)))
            for at in range(0, len(right), 512):
                part = right.slice(at, 512).combine_chunks()
                score = _unit(_matrix(part["q"].chunk(0))) @ x.T
                keep = score >= np.partition(score, -k, axis=1)[:, [-k]] - 1e-12 if len(x) > k else np.ones_like(score, bool)
                i, j = np.nonzero(keep)
                out.append(pa.table({"query_id": part["query_id"].take(pa.array(i)), "id": left["id"].take(pa.array(j)), "score": pa.array(score[i, j])}))
        none = pa.table({"query_id": right["query_id"].slice(0, 0), "id": left["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.concat_tables(out) if out else none

    found = items.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(best, f"query_id {qkind}, id {kind}, score double")
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, where: Column | None = None, candidates: int | None = None, exact: bool = False, id_col: str = "id", vector: str = "embedding", sources: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k vectors nearest to each query (query_id, vector) by cosine; ties go to the smaller id.

    Only rows that pass ``where`` count. Each query looks into its best cells until these hold ``candidates`` such rows (100 times k
    unless given). With ``exact``, it then looks into every further cell whose bound is above its k-th score, so that nothing
    nearer is missed. Queries with unusable vectors have no result.
    """
    rows = versioned.read(spark, path)
    rows = rows.where(F.col("source").isin(sources)) if sources is not None else rows
    rows = rows.where(where) if where is not None else rows
    cells, centers = _cells(rows), centroids(spark, path)
    queries = queries.select("query_id", "vector").where(usable("vector", centers.shape[1]))
    if not cells:
        return rows.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    first = probes(queries, centers, cells, 100 * k if candidates is None else candidates)
    found = _score(rows, first.join(queries, "query_id"), k, cells, id_col, vector)
    if not exact:
        return found
    reached = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    total = sum(n for n, _ in cells.values())
    more = probes(queries, centers, cells, total + 1).join(first.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(reached, "query_id", "left")
    more = more.where(F.col("kth").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("kth"))).select("query_id", "cell")
    rest = _score(rows, more.join(queries, "query_id"), k, cells, id_col, vector)
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_read(spark: SparkSession, path: str, queries: DataFrame, k: int, where: Column | None = None, candidates: int | None = None) -> DataFrame:
    """(query_id, cells, share): how many cells a query looks into, and the share of the rows passing the filter that they hold."""
    rows = versioned.read(spark, path)
    rows = rows.where(where) if where is not None else rows
    cells = _cells(rows)
    sizes = spark.createDataFrame([(c, n) for c, (n, _) in cells.items()], "cell int, n long")
    found = probes(queries, centroids(spark, path), cells, 100 * k if candidates is None else candidates).join(F.broadcast(sizes), "cell")
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), (F.sum("n") / sum(n for n, _ in cells.values())).alias("share"))
