"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.materialize import free, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("low").alias("b")))


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the least node of its component.

    Both steps only rewrite edges, never more of them than before, by aggregations with map-side combine and joins whose large side
    can be split when a hub is hot. Rounds grow with the logarithm of the longest path. Each round's edges are a table in the
    shared folder, so neither lineage nor a lost executor costs earlier rounds.
    """
    edges = edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    mark = None
    for _ in range(max_rounds):
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or mark == tuple(sums):
            break
        mark = tuple(sums)
        done, edges = edges, materialize(_small_star(_large_star(edges).distinct()).distinct())
        free(done)
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(edges.select(F.col("b"), F.col("b"))).distinct()
