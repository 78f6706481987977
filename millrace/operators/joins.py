"""Joins the built-in ones don't cover: interval joins by bucket, incident edges, temporal neighbours, similarity links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.columns import col
from millrace.functions.scoring import proximity


def within_time(left: DataFrame, right: DataFrame, key: str, time_left: str, time_right: str, minutes: float) -> DataFrame:
    """Equi-join on ``key`` with times at most ``minutes`` apart: each left row probes its time bucket and both neighbours.

    A hash join on (key, bucket) instead of one on the key and a filter, so a busy key is spread over its buckets.
    """
    width = int(minutes * 60_000_000)
    bucket = lambda t: F.floor(F.unix_micros(F.col(t)) / width)
    probes = left.withColumn("__b", F.explode(F.array(*[bucket(time_left) + d for d in (-1, 0, 1)])))
    stored = right.withColumn("__b", bucket(time_right))
    near = F.abs(F.unix_micros(time_left) - F.unix_micros(time_right)) <= width
    return probes.join(stored, [key, "__b"]).where(near).drop("__b")


def temporal_links(events: DataFrame, key: str, id_col: str, time: str, minutes: float = 30.0, limit: int = 10) -> DataFrame:
    """(a, b, weight): each row with its ``limit`` nearest in time of the same key, weight 1 - gap / minutes, at least .3.

    Rows of one time are told by their ``limit`` + 1 least ids, and a time's neighbours are at most ``limit`` times away in either
    direction, so a busy key gives rows times a constant, not pairs. Keys are cut into buckets of time that also see the next ones.
    Rows without key, id or time have no link.
    """
    width = int(minutes * 60_000_000)
    rows = events.select(F.col(key).alias("key"), F.col(id_col).alias("a"), F.unix_micros(time).alias("t")).dropna()
    least = F.dense_rank().over(W.Window.partitionBy("key", "t").orderBy("a"))
    times = rows.withColumn("n", least).where(F.col("n") <= limit + 1).groupBy("key", "t").agg(F.sort_array(F.collect_set("a")).alias("ids"))
    bucket = F.floor(F.col("t") / width)
    around = W.Window.partitionBy("key", "bucket").orderBy("t").rowsBetween(-limit, limit)
    seen = times.withColumn("bucket", F.explode(F.array(*[bucket + d for d in (-1, 0, 1)]))).withColumn("near", F.collect_list(F.struct("t", "ids")).over(around))
    met = rows.join(seen.where(F.col("bucket") == bucket).select("key", "t", "near"), ["key", "t"])
    gaps = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(F.abs(x["t"] - F.col("t")).alias("gap"), i.alias("b")))))
    nearest = F.slice(F.array_sort(F.filter(gaps, lambda x: (x["gap"] <= width) & (x["b"] != F.col("a")))), 1, limit)
    return met.select("a", F.explode(nearest).alias("x")).select("a", "x.b", proximity(F.col("x.gap") / 60_000_000.0, minutes).alias("weight"))


def shared_key_links(rows: DataFrame, key: str, id_col: str, order: str, limit: int = 20, weight: float = 0.6) -> DataFrame:
    """(a, b, weight): each row with the ``limit`` rows of its key that follow it in ``order``.

    Neighbours by rank replace a self-join on the key, so a large key gives rows times limit pairs.
    """
    ranked = rows.select(key, id_col, F.row_number().over(W.Window.partitionBy(key).orderBy(order, id_col)).alias("__r"))
    probes = ranked.select(key, F.col(id_col).alias("a"), F.explode(F.sequence(F.col("__r") + 1, F.col("__r") + limit)).alias("__r"))
    return probes.join(ranked.select(key, F.col(id_col).alias("b"), "__r"), [key, "__r"]).select("a", "b", F.lit(weight).alias("weight"))


def incident_counts(vertices: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges that start or end at each vertex (a loop counts once): endpoints are exploded into an equi-join, no OR condition."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias(id_col)).groupBy(id_col).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.join(ends, id_col, "left").fillna(0, ["degree"])


def with_both_ends(edges: DataFrame, kept: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges whose source and target are both kept."""
    return edges.join(kept.select(F.col(id_col).alias("source")), "source", "left_semi").join(kept.select(F.col(id_col).alias("target")), "target", "left_semi").select(*edges.columns)


def with_valid_edge(vertices: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Vertices with at least one of the edges."""
    return vertices.join(edges.select(F.explode(F.array("source", "target")).alias(id_col)), id_col, "left_semi")


def labelled_edges(edges: DataFrame, vertices: DataFrame, id_col: str = "id", name: str = "name") -> DataFrame:
    """Edges with the names of both ends, null where a vertex is missing."""
    names = lambda end: vertices.select(F.col(id_col).alias(end), F.col(name).alias(f"{end}_name"))
    return edges.join(names("source"), "source", "left").join(names("target"), "target", "left")


def without_recent(rows: DataFrame, recent: DataFrame, key: str, time: str, since: Column) -> DataFrame:
    """Rows whose key has no recent entry since a time."""
    return rows.join(recent.where(col(time) >= since).select(key).distinct(), key, "left_anti")


#: Rows of a tile; two tiles meet in one matrix product.
TILE = 2000


def unit_vectors(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of equally long vectors, scaled to length one; zero vectors stay."""
    x = np.array(lists.to_pylist(), float)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _in_tiles(vectors: DataFrame, block: str, id_col: str, vector: str, order: str | None = None) -> GroupedData:
    """Rows (block, i, j, id, v, t, and r if given) by pairs of tiles i <= j of a block, so no block must fit in one task."""
    vectors = vectors.where(F.col(vector).isNotNull())
    sizes = vectors.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    rows = vectors.join(sizes, block).withColumn("t", F.pmod(F.xxhash64(id_col), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    r = [F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))).alias("r")] if order else []
    rows = rows.select(F.col(block).alias("block"), F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), "t", other.alias("o"), *r)
    rows = rows.withColumn("i", F.least("t", "o")).withColumn("j", F.greatest("t", "o"))
    return rows.drop("o").groupBy("block", "i", "j")


def _distances(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of a pair of tiles, the rows of the first, those of the second, their cosine distances, and whether it is one tile."""
    x, t = unit_vectors(table.column("v")), table.column("t").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    first, second = np.flatnonzero(t == i), np.flatnonzero(t == j)
    return first, second, 1 - x[first] @ x[second].T, i == j


def nearest_under(vectors: DataFrame, block: str, id_col: str, vector: str, max_distance: float) -> DataFrame:
    """(a, b, distance): pairs of one block whose cosine distance is ``max_distance`` or less, a < b.

    All pairs are the result; ``nearest_above`` and ``stars_under`` give as many rows as there are vectors.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def pairs(table: pa.Table) -> pa.Table:
        first, second, d, same = _distances(table)
        ids = np.array(table.column("id").to_pylist())
        a, b = np.nonzero(d <= max_distance)
        p, q = ids[first[a]], ids[second[b]]
        keep = (p < q) if same else np.ones(len(p), bool)
        low, high = np.minimum(p, q)[keep], np.maximum(p, q)[keep]
        return pa.table({"a": low, "b": high, "distance": d[a, b][keep]})

    return _in_tiles(vectors, block, id_col, vector).applyInArrow(pairs, f"a {kind}, b {kind}, distance double")


def nearest_above(vectors: DataFrame, block: str, id_col: str, vector: str, order: str, max_distance: float, highest: bool = False) -> DataFrame:
    """(a, b, distance): each row with the nearest of its block within ``max_distance`` that has a higher ``order`` (ties: a smaller id).

    With ``highest`` it is the one of the highest order. Of several, the one with the smallest id. A pair of tiles passes on one row
    for each of theirs.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        first, second, d, same = _distances(table)
        r, found = table.column("r").to_numpy(), []
        for x, y, far in [(first, second, d)] + ([] if same else [(second, first, d.T)]):
            above = (r[y] > r[x][:, None]) | ((r[y] == r[x][:, None]) & (y < x[:, None]))
            wanted = above & (far <= max_distance)
            rows = np.flatnonzero(wanted.any(1))
            cost = np.where(wanted[rows], -r[y] if highest else far[rows], np.inf)
            at = cost.argmin(1) if len(rows) else rows  # columns are in the order of ids
            found.append((x[rows], y[at], far[rows, at]))
        a, b, distance = (np.concatenate(c) for c in zip(*found, strict=True))
        ids = table.column("id")
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "r": -r[b], "distance": distance})

    tiles = _in_tiles(vectors, block, id_col, vector, order).applyInArrow(best, f"a {kind}, b {kind}, r double, distance double")
    return tiles.groupBy("a").agg(F.min(F.struct("r" if highest else "distance", "b", F.col("distance").alias("d"))).alias("m")).select("a", "m.b", F.col("m.d").alias("distance"))


def groups_of(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each component of a two-sided graph; every row and column is visited once."""
    rows, columns = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
    for r in range(len(rows)):
        if not rows[r]:
            continue
        rows[r] = False
        step, in_rows, in_columns = np.array([r]), [np.array([r])], []
        while len(step):
            met = np.flatnonzero(near[step].any(0) & columns)
            columns[met] = False
            step = np.flatnonzero(near[:, met].any(1) & rows)
            rows[step] = False
            in_rows.append(step)
            in_columns.append(met)
        yield np.concatenate(in_rows), np.concatenate(in_columns)


def stars_under(vectors: DataFrame, block: str, id_col: str, vector: str, max_distance: float) -> DataFrame:
    """(a, b) that connect what pairs of one block within ``max_distance`` connect: in each pair of tiles a component's least id with
    its other members, so many copies give no pairs in the square of their number."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def stars(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        first, second, d, same = _distances(table)
        near = d <= max_distance
        if same:
            np.fill_diagonal(near, True)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in groups_of(near):
            members = np.union1d(first[x], second[y])
            a.append(np.full(len(members) - 1, members[0]))
            b.append(members[1:])
        ids = table.column("id")
        return pa.table({"a": ids.take(pa.array(np.concatenate(a))), "b": ids.take(pa.array(np.concatenate(b)))})

    return _in_tiles(vectors, block, id_col, vector).applyInArrow(stars, f"a {kind}, b {kind}")


def supersession_history(facts: DataFrame, id_col: str, superseded_by: str) -> DataFrame:
    """(id, superseded_id): each fact with the facts it took the place of."""
    earlier = facts.where(F.col(superseded_by).isNotNull()).select(F.col(superseded_by).alias(id_col), F.col(id_col).alias("superseded_id"))
    return facts.select(id_col).join(earlier, id_col)


def with_profiles(items: DataFrame, user: str, profiles: DataFrame, profile_user: str, state: str, path: str) -> DataFrame:
    """Items with ``author``: the value at ``path`` of the user's JSON state, else the user's id."""
    names = profiles.select(F.col(profile_user).alias("__user"), F.get_json_object(state, path).alias("__name"))
    joined = items.join(names, F.col(user) == F.col("__user"), "left")
    return joined.withColumn("author", F.coalesce(F.nullif("__name", F.lit("")), F.col(user).cast("string"))).drop("__user", "__name")


def dyadic_cover(start: Column, end: Column, bits: int) -> Column:
    """Array of (level, node): the fewest aligned blocks of 2 ** level units that make up the units from ``start`` to ``end``, exclusive.

    At each level at most two blocks are needed, one at either end, so an interval of any length has some 2 * ``bits`` at most.
    """

    def blocks(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.call_function("shiftright", start + size - 1, level), F.call_function("shiftright", end, level)
        block = lambda node: F.struct(level.alias("level"), node.alias("node"))
        left = F.when((low < high) & (low % 2 != 0), block(low))
        right = F.when((low < high) & (high % 2 != 0), block(high - 1))
        return F.filter(F.array(left, right), lambda b: b.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), blocks))


def _points_within(points: DataFrame, intervals: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Pairs (p, i) of points (p, t, keys) and intervals (i, low, high, keys) with low <= t < high, each once: equal blocks meet."""
    covered = intervals.select("i", *keys, F.explode(dyadic_cover(F.col("low"), F.col("high"), bits)).alias("b")).select("i", *keys, "b.*")
    level = F.explode(F.sequence(F.lit(0), F.lit(bits)))
    blocks = points.select("p", "t", *keys, level.alias("level")).select("p", *keys, "level", F.expr("shiftright(t, level)").alias("node"))
    # both sides are many times what the planner estimates of them before the blocks are laid out, so neither is broadcast
    return blocks.join(covered.hint("merge"), [*keys, "level", "node"]).select("p", "i")


def overlapping(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str], start: str = "start", end: str = "end", unit: int = 1) -> DataFrame:
    """(a, b): ids of the intervals of ``left`` and ``right`` that overlap and have equal ``keys``; ends are exclusive.

    Times are integers in the same scale on both sides; ``unit`` is the finest step that tells them apart (all are multiples of it).
    Two intervals overlap if one holds the other's start, so it is an equi-join on blocks of time: an interval is cut into aligned
    blocks of lengths 2 ** n, a start lies in one block of each length, and they meet in exactly one. Intervals of any lengths
    go together; long ones meet in coarse blocks, so no short interval is copied for their sake. A null end is open, a null start
    or an empty interval overlaps nothing, null keys are equal to none.
    """
    side = lambda d, i: d.select(F.col(i).alias("i"), *keys, F.floor(F.col(start) / unit).alias("low"), F.floor(F.coalesce(F.col(end), F.lit((1 << 62) - 1)) / unit).alias("high")).where("low < high")
    a, b = side(left, left_id), side(right, right_id)
    bounds = a.select("low", "high").union(b.select("low", "high")).agg(F.min("low").alias("x"), F.max("low").alias("y")).first()
    if bounds["x"] is None:
        return a.select(F.col("i").alias("a")).crossJoin(b.select(F.col("i").alias("b")).limit(0)).limit(0)
    first, span = bounds["x"], bounds["y"] - bounds["x"] + 1  # what lies behind the last start meets nothing
    bits = max(1, span.bit_length())
    moved = lambda d: d.select("i", *keys, (F.col("low") - first).alias("low"), F.least(F.col("high") - first, F.lit(span)).alias("high"))
    a, b = moved(a), moved(b)
    starts = lambda d: d.select(F.col("i").alias("p"), *keys, F.col("low").alias("t"))
    later = _points_within(starts(b), a, keys, bits).select(F.col("i").alias("a"), F.col("p").alias("b"))
    before = b.withColumn("low", F.col("low") + 1)  # equal starts are told once
    earlier = _points_within(starts(a), before, keys, bits).select(F.col("p").alias("a"), F.col("i").alias("b"))
    return later.union(earlier)


def overlap_totals(left: DataFrame, right: DataFrame, left_id: str, value: str, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(a, n, total): of each id of ``left`` that ``overlapping`` pairs, the number of its pairs and the sum of ``value``, an integer.

    No pair is made: an interval overlaps what starts before its end, less what ends at its start or before. Both are running sums
    over the times of a key, which an interval looks up at its ends, so work and disk grow with rows and not with pairs. Times are
    integers; sums are taken wide, as those of a whole key may leave the range in which a total lies. Null values count 0.
    """
    open_end = F.lit((1 << 62) - 1)
    side = lambda d, c: d.select(c.alias("v"), *keys, F.col(start).cast("long").alias("low"), F.coalesce(F.col(end).cast("long"), open_end).alias("high")).where("low < high").dropna(subset=keys)
    a, b = side(left, F.col(left_id)), side(right, F.coalesce(F.col(value).cast("long"), F.lit(0)))
    ends = F.explode(F.array(F.struct(F.col("low").alias("t"), F.lit(False).alias("last")), F.struct(F.col("high").alias("t"), F.lit(True).alias("last"))))
    told = b.select("v", *keys, ends.alias("e")).groupBy(*keys, F.col("e.t").alias("t")).agg(
        *[F.sum(F.when(F.col("e.last") == last, one).otherwise(0)).alias(name) for last, name, one in ((False, "n", F.lit(1)), (False, "s", F.col("v").cast("decimal(20,0)")), (True, "n_end", F.lit(1)), (True, "s_end", F.col("v").cast("decimal(20,0)")))]
    )
    # what starts before an end does so a step earlier at the latest
    asked = a.select("v", *keys, F.explode(F.array(F.struct((F.col("high") - 1).alias("t"), F.lit(True).alias("last")), F.struct(F.col("low").alias("t"), F.lit(False).alias("last")))).alias("e")).select("v", *keys, "e.*")
    asked_at = asked.select(*keys, "t").distinct()
    so_far = W.Window.partitionBy(*keys).orderBy("t").rowsBetween(W.Window.unboundedPreceding, 0)
    sums = told.join(asked_at, [*keys, "t"], "full_outer").select(*keys, "t", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in ("n", "s", "n_end", "s_end")])
    met = asked.join(sums, [*keys, "t"])
    signed = lambda c: F.when(F.col("last"), F.col(c)).otherwise(-F.col(f"{c}_end"))
    out = met.groupBy(F.col("v").alias("a")).agg(F.sum(signed("n")).alias("n"), F.sum(signed("s")).cast("long").alias("total"))
    return out.where("n > 0")
