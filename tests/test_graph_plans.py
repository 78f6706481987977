"""Graph rounds at size: what they shuffle, told by the plans of the tables they write."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.plans.materialize import bucketed, free, shuffle_parts


@pytest.fixture
def written(spark, monkeypatch):
    """Plans of the tables that graph operators write, made as if every table were too large to broadcast."""
    plans = []
    write = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield plans
    for name in names:
        spark.conf.unset(name)


def edges(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(40)}", f"s{rng.randrange(12)}", float(rng.randrange(1, 9))) for _ in range(300)]
    return spark.createDataFrame(rows, "source string, target string, weight double")


def test_bucketed_tables_are_joined_in_place(spark, written):
    n = shuffle_parts(spark)
    table = bucketed(edges(spark).repartition(n, "source"), "source", n)
    joined = table.join(edges(spark).groupBy("source").agg(F.sum("weight").alias("total")), "source")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert f"SelectedBucketsCount: {n} out of {n}" in plan and joined.count() == 300
    free(table)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("millrace_")]


def test_pagerank_and_communities_leave_links_in_their_buckets(spark, written):
    G.pagerank(edges(spark), iterations=2, tolerance=0.0).collect()
    assert sum("SelectedBucketsCount" in p for p in written) >= 2
    written.clear()
    G.communities(edges(spark), rounds=2).collect()
    assert sum("SelectedBucketsCount" in p for p in written) >= 2


def test_decay_expansion_groups_no_links(spark, written):
    got = {r.id: r.score for r in G.decay_expansion(edges(spark), spark.createDataFrame([("s1",)], "id string"), 2, 0.5, 100).collect()}
    assert not [p for p in written if "keys=[src" in p]
    links, score, front = [tuple(r) for r in G.both_ways(edges(spark), "weight").collect()], {"s1": 1.0}, {"s1"}
    for d in (1, 2):
        gain = {}
        for a, b, w in links:
            if a in front and b not in score:
                gain[b] = max(gain.get(b, 0.0), 0.5**d * w)
        score, front = score | gain, set(gain)
    assert got == pytest.approx({k: v / max(score.values()) for k, v in score.items()})


def test_rewritten_endpoints_are_looked_up_in_place(spark, written):
    merges = spark.createDataFrame([("s3", "s2"), ("s6", "s5")], "old string, new string")
    kept = edges(spark).select(F.explode(F.array("source", "target")).alias("id")).distinct().where("id not in ('s3', 's6')")
    found = G.rewrite_endpoints(edges(spark).withColumn("type", F.lit("t")), merges, kept)
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
    want: dict = {}
    for a, b, w in (tuple(r) for r in edges(spark).collect()):
        b = {"s3": "s2", "s6": "s5"}.get(b, b)
        want[a, b] = want.get((a, b), 0.0) + w
    assert {(r.source, r.target): r.weight for r in found.collect()} == want
