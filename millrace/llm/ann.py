"""Approximate nearest neighbours by multi-probe p-stable hashing.

Each of several tables hashes a unit vector to the cell floor((a.x + b) / w) of Gaussian projections a. A query visits its own cell
and perturbed ones in the order of their estimated success: the sum of squared distances to the cell walls that a perturbation
crosses. Candidates of all tables are merged and ranked by their exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.plans.materialize import broadcast_if_small, materialize

#: Vectors and queries of the sample that parameters are fitted on.
SAMPLE, SAMPLE_QUERIES = 4096, 128
#: Index rows of one slot (what a task compares queries with at once); larger buckets are salted over several.
SLOT_ROWS = 4096


@dataclass(frozen=True)
class Hashes:
    """``project[t]``: projections of table t, ``shift[t]``: offsets, both in units of the cell width; ``probes`` a table."""

    project: np.ndarray
    shift: np.ndarray
    probes: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(table, row, projection) positions, in cells."""
        return np.einsum("nd,tdk->tnk", x, self.project) + self.shift[:, None, :]


def _bucket(cells: np.ndarray) -> np.ndarray:
    """64-bit hash of the last axis."""
    h = np.full(cells.shape[:-1], 0x243F6A8885A308D3, np.uint64)
    for k in range(cells.shape[-1]):
        h = (h ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def probe_order(inside: np.ndarray, most: int) -> list[list[tuple[int, int]]]:
    """Perturbations (projection, -1 or 1) of a position in its cell (0 to 1), best estimated success first, from none at all."""
    walls = sorted([(f * f, i, -1) for i, f in enumerate(inside.tolist())] + [((1 - f) ** 2, i, 1) for i, f in enumerate(inside.tolist())])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(walls[0][0], (0,))]
    while heap and len(out) < most:
        cost, chosen = heapq.heappop(heap)
        if len({walls[j][1] for j in chosen}) == len(chosen):  # not both walls of one projection
            out.append([walls[j][1:] for j in chosen])
        last = chosen[-1]
        if last + 1 < len(walls):
            heapq.heappush(heap, (cost - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + walls[last + 1][0], (*chosen, last + 1)))
    return out


def _probes(hashes: Hashes, x: np.ndarray) -> np.ndarray:
    """Buckets (row, table, probe) to visit, padded with the own one."""
    places = hashes.cells(x)
    cells = np.floor(places).astype(np.int64)
    out = np.empty((len(x), len(cells), hashes.probes), np.int64)
    for t in range(len(cells)):
        for i in range(len(x)):
            visits = np.repeat(cells[t, i][None], hashes.probes, 0)
            for p, moves in enumerate(probe_order(places[t, i] - cells[t, i], hashes.probes)):
                for k, step in moves:
                    visits[p, k] += step
            out[i, t] = _bucket(visits)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(sample: np.ndarray, rows: int, k: int = 5, tables: int = 8, most_probes: int = 200, recall: float = 0.97, seed: int = 11) -> Hashes:
    """Choose cell width, projections and probes on a bounded sample, so that ``recall`` of its k nearest are found.

    Cells are twice as wide as the k-th nearest neighbour is far. Projections start at about log2(rows) - 4, so buckets stay small
    as the data grow, and are reduced until ``most_probes`` visits or fewer a table reach the recall; else cells are widened. Neighbours in the whole
    table are nearer than in a sample, so its recall is higher.
    """
    rng = np.random.default_rng(seed)
    x = unit(sample.astype(float))
    queries = x[:SAMPLE_QUERIES]
    near = queries @ x.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -2
    k = min(k, len(x) - 1)
    dim = x.shape[1]
    if k < 1:
        return Hashes(rng.standard_normal((tables, dim, 1)) / 8.0, np.zeros((tables, 1)), 2)
    top = np.argsort(-near, 1)[:, :k]
    width = max(1e-6, 2 * float(np.median(np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(near, top[:, -1:], 1))))))
    most = int(min(24, max(4, np.log2(max(2, rows)) - 4)))
    while True:
        for count in range(most, 1, -2):
            hashes = Hashes(rng.standard_normal((tables, dim, count)) / width, rng.uniform(0, 1, (tables, count)), most_probes)
            mine = _bucket(np.floor(hashes.cells(x)))
            visits = _probes(hashes, queries)
            # the number of the probe that finds each true neighbour, least over the tables
            found = np.full((len(queries), k), most_probes)
            for t in range(tables):
                match = visits[:, t, None, :] == mine[t][top][:, :, None]
                found = np.minimum(found, np.where(match.any(2), match.argmax(2), most_probes))
            for probes in (1, 2, 4, 8, 16, 32, 64, 100, 140, most_probes):
                if (found < probes).mean() >= recall:
                    return Hashes(hashes.project, hashes.shift, probes)
        width *= 2  # in the end one cell holds all


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _index(batches: Iterator[pa.RecordBatch], hashes: Hashes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _vectors(batch.column(0))
        tables = len(hashes.project)
        row = np.tile(np.arange(len(x)), tables)
        taken = batch.take(pa.array(row))
        buckets = _bucket(np.floor(hashes.cells(unit(x)))).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(x))), pa.array(buckets), *taken.columns], names=["tab", "bucket", *taken.schema.names])


def _visit(batches: Iterator[pa.RecordBatch], hashes: Hashes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x = unit(_vectors(part.column(1)))
            b = _probes(hashes, x)
            n, tables, probes = b.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), tables * probes)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n)), pa.array(b.reshape(-1))], names=["query", "tab", "bucket"])


def _rank(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (slot, kind, bucket, vector, ids, cls, query, visits) by slot, index rows before queries: each query's best of the slot."""
    slot, held, index = None, [], None
    for batch in batches:
        slots, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (slots[1:] != slots[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if slots[a] != slot:
                slot, held, index = slots[a], [], None
            if kinds[a] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if index is None:
                table = pa.Table.from_batches(held).combine_chunks()
                x = unit(_vectors(table.column("vector").combine_chunks()))
                bucket = table.column("bucket").to_numpy()
                order = np.argsort(bucket, kind="stable")
                table = table.take(pa.array(order))
                index = x[order], bucket[order], table.column("ids").to_pylist(), table.column("cls").to_pylist(), table.column("vector").combine_chunks()
            x, bucket, ids, cls, raw = index
            q = unit(_vectors(part.column(3)))
            out: list[tuple] = []
            query = part.column(6).to_pylist()
            for i, visits in enumerate(part.column(7).to_pylist()):
                if visits is None:  # all rows of the slot
                    at = np.arange(len(bucket))
                else:
                    visits = np.unique(np.array(visits, np.int64))
                    low, high = np.searchsorted(bucket, visits, "left"), np.searchsorted(bucket, visits, "right")
                    n = high - low
                    at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
                if not len(at):
                    continue
                score = x[at] @ q[i]
                if len(at) > k + 1:  # the query's own class is one of them; near-equal scores at the border stay
                    at = at[score >= np.partition(score, -(k + 1))[-(k + 1)] - 1e-9]
                exact = _vectors(raw.take(pa.array(at)))
                mine = _vectors(part.column(3).slice(i, 1))[0]
                for c, s, v in zip(at.tolist(), cosine(exact, mine).tolist(), exact, strict=True):
                    out.append((query[i], cls[c], bool((v == mine).all()), s, ids[c]))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.int64()))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query", "cls", "own", "score", "ids"])


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the rows of x with q, in double precision; each row's sum has one order, so equal vectors score equally."""
    sx, sq = np.abs(x).max(1, keepdims=True), np.abs(q).max()
    scale = lambda m: np.where((m > 1e100) | (m < 1e-100), m, 1.0)  # noqa: E731  only where squares would overflow or vanish
    x, q = x / scale(sx), q / scale(sq)
    return np.array([r @ q for r in x]) / (np.sqrt(np.array([r @ r for r in x])) * np.sqrt(q @ q))


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, hashes: Hashes | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines found for each row where ``queries`` holds, among all other rows.

    Nearest first, ties to the smaller id. Unusable vectors (see ``usable``) and rows without an id take no part; vectors are
    compared with those of the commonest length only. Rows with equal vectors are one index entry that carries its k+1 smallest
    ids, all that can be returned, so a group of copies is no hot bucket. Other columns are ignored.
    """
    rows = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("vector") == size.n)
    order = W.Window.partitionBy("vector").orderBy("id")  # its bound of k+1 is applied before the shuffle too
    classes = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    if hashes is None:
        sample = classes.orderBy(F.xxhash64(F.col("ids")[0])).select("vector").limit(SAMPLE).toArrow()
        hashes = fit(_vectors(sample.column(0).combine_chunks()), n, k)
    shared = spark.sparkContext.broadcast(hashes)

    kind = rows.schema["vector"].dataType.simpleString()
    index = classes.mapInArrow(lambda it: _index(it, shared.value), f"tab int, bucket long, vector {kind}, ids array<bigint>, cls long")
    asked = rows.where("asks").select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), "vector")
    asked = materialize(asked)
    visits = asked.select("query", "vector").mapInArrow(lambda it: _visit(it, shared.value), "query long, tab int, bucket long")

    # buckets of more than a slot are salted: their index rows are dealt by vector, their visitors go to every part
    large = classes.mapInArrow(lambda it: _index(it, shared.value), f"tab int, bucket long, vector {kind}, ids array<bigint>, cls long").groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(large.where(F.col("n") > SLOT_ROWS).select("tab", "bucket", F.ceil(F.col("n") / SLOT_ROWS).cast("int").alias("salts")))
    large = broadcast_if_small(large)
    slots = max(1, -(-n // SLOT_ROWS)) * len(hashes.project)
    slot = F.pmod(F.xxhash64("tab", "bucket", "salt"), F.lit(slots)).cast("int").alias("slot")
    index = index.join(large, ["tab", "bucket"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("vector"), F.col("salts")).cast("int"), F.lit(0)))
    visits = visits.distinct().join(large, ["tab", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    # a query goes to a slot once, with all the buckets it visits there
    visits = visits.groupBy("query", slot).agg(F.collect_list("bucket").alias("visits")).join(asked, "query")
    ranked = _in_slots(index.select(slot, "bucket", "vector", "ids", "cls"), visits.select("slot", "query", "vector", "visits"), slots, k)
    found = materialize(_best(ranked, asked, k))
    # a query far from all others may meet fewer rows than it can have: it is compared with all of them, in blocks
    short = asked.join(found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "query", "left_anti")
    short = materialize(short)
    if not short.isEmpty():
        blocks = max(1, -(-n // SLOT_ROWS))
        block = classes.select(F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int").alias("slot"), F.lit(0).cast("long").alias("bucket"), "vector", "ids", "cls")
        everywhere = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("slot"), "query", "vector", F.lit(None).cast("array<bigint>").alias("visits"))
        found = found.join(short, "query", "left_anti").union(_best(_in_slots(block, everywhere, blocks, k), short, k))
    return found.select("query_id", "rank", "vec_id", "score")


def _in_slots(index: DataFrame, visits: DataFrame, slots: int, k: int) -> DataFrame:
    """Each query's best of every slot it visits."""
    both = index.select("slot", F.lit(0).alias("kind"), "bucket", "vector", "ids", "cls", F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<bigint>").alias("visits")).union(
        visits.select("slot", F.lit(1), F.lit(0).cast("long"), "vector", F.lit(None).cast("array<bigint>"), F.lit(None).cast("long"), "query", "visits")
    )
    return both.repartition(slots, "slot").sortWithinPartitions("slot", "kind").mapInArrow(lambda it: _rank(it, k), "query long, cls long, own boolean, score double, ids array<bigint>")


def _best(ranked: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, query_id, rank, vec_id, score): the tables' and slots' candidates merged, without the query's own row."""
    merged = ranked.dropDuplicates(["query", "cls"]).join(asked.select("query", "query_id"), "query")
    own = F.array_position("ids", F.col("query_id")).cast("int")
    others = F.when(F.col("own") & (own > 0), F.filter("ids", lambda v, i: i != own - 1)).otherwise(F.col("ids"))
    found = merged.select("query", "query_id", "score", F.explode(others).alias("vec_id"))
    best = W.Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
