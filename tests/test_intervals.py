"""Interval joins against all pairs; canonical aggregates on planted mentions."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import joins as J

SCHEMA = "id int, k string, start long, end long"


def overlaps(left, right):
    inf = 1 << 62
    real = lambda r: r[1] is not None and r[2] is not None and r[2] < (inf if r[3] is None else r[3])
    return sorted((a[0], b[0]) for a in left for b in right if real(a) and real(b) and a[1] == b[1] and a[2] < (b[3] or inf) and b[2] < (a[3] or inf))


@pytest.mark.parametrize("scale", [1, 3600])
def test_overlaps_of_any_length_are_told_once(spark, scale):
    rng = random.Random(scale)

    def some(n):
        out = []
        for i in range(n):
            start = rng.randrange(-50, 400) * scale
            length = rng.choice([0, 1, 2, 5, 17, 200, 10**6, -3]) * scale
            out.append((i, rng.choice(["x", "y", None]), rng.choice([start, start, start, None]), rng.choice([start + length, start + length, None])))
        return out + [(900, "x", 0, 5 * scale), (900, "x", 0, 5 * scale)]

    left, right = some(150), some(120)
    got = J.overlapping(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "id", "id", ["k"], unit=scale)
    assert sorted(map(tuple, got.collect())) == overlaps(left, right)
    none = spark.createDataFrame([], SCHEMA)
    assert J.overlapping(none, none, "id", "id", ["k"]).count() == 0
    assert J.overlapping(none, spark.createDataFrame(right, SCHEMA), "id", "id", ["k"]).count() == 0


def test_overlap_totals_are_those_of_all_pairs(spark):
    rng = random.Random(5)

    def some(n):
        start = [rng.randrange(-50, 100) for _ in range(n)]
        return [(rng.randrange(60), rng.choice(["x", "y", None]), rng.choice([s, s, s, None]), rng.choice([s + rng.choice([0, 1, 2, 17, 300, -3]), None])) for s in start]

    left, right = some(150), some(120)
    want = {}
    for a, b in overlaps(left, right):
        n, total = want.get(a, (0, 0))
        want[a] = n + 1, total + b
    got = J.overlap_totals(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "id", "id", ["k"])
    assert {r.a: (r.n, r.total) for r in got.collect()} == want
    assert J.overlap_totals(spark.createDataFrame([], SCHEMA), spark.createDataFrame(right, SCHEMA), "id", "id", ["k"]).count() == 0
    # sums of the key leave the range of its totals
    big = spark.createDataFrame([((1 << 62), "x", t, t + 1) for t in range(9)], "id long, k string, start long, end long")
    assert [tuple(r) for r in J.overlap_totals(spark.createDataFrame([(1, "x", 8, 9)], SCHEMA), big, "id", "id", ["k"]).collect()] == [(1, 1, 1 << 62)]


def test_overlapping_windows_makes_no_pairs(spark, monkeypatch, sf):
    """Pairs grow with the square of the tables."""
    from millrace.queries import intervals

    monkeypatch.setattr(J, "overlapping", None)
    assert intervals.overlapping_windows(spark, sf).count() > 0


def test_canonical_aggregates_of_planted_mentions(spark):
    schema = "canonical string, corpus string, name string, type string, n int, vector array<double>, seq long, review boolean"
    rows = [("a", f"c{i % 3}", f"n{i}", "concept", 1, [1.0, 0.0], i, False) for i in range(40)] + [("a", "c9", "late", "Person", None, [0.0, 1.0], 100 + i, True) for i in range(8)]
    rows += [("b", "c0", "x", "person", 2, None, 1, False), ("b", "c0", "x", None, 2, [3.0], 2, False), ("b", "c0", "y", "person", 2, [1.0, 1.0, 1.0], 3, None)]
    got = {r.canonical: r for r in A.canonical_aggregates(spark.createDataFrame(rows, schema), 8).collect()}
    a, b = got["a"], got["b"]
    assert (a.total, a.corpus_count, a.main_type, a.under_review, a.stopword_like) == (48, 4, "person", False, True)  # 8 of 48 are over 15 %
    assert len(a.aliases) == 32 and a.aliases[-1].name == "late" and a.aliases[-1].score == 0.7 and [x.seq for x in a.aliases] == sorted(x.seq for x in a.aliases)
    assert a.centroid == pytest.approx([40 / (40**2 + 8**2) ** 0.5, 8 / (40**2 + 8**2) ** 0.5])
    assert (b.main_type, b.under_review, b.stopword_like) == ("person", True, False)
    assert b.centroid == pytest.approx([3**-0.5] * 3)  # of lengths held equally often, the longer one
    assert A.canonical_aggregates(spark.createDataFrame([], schema), 8).count() == 0


def test_no_side_is_broadcast(spark):
    rows = spark.range(50).select("id", F.lit(1).alias("k"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
    plan = J.overlapping(rows, rows, "id", "id", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
