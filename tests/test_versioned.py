"""Atomic writes by source."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.materialize import shared_dir
from millrace.sources import versioned as V


@pytest.fixture
def path(spark, tmp_path):
    return f"file://{tmp_path}/t"


def rows(spark, source, values, extra=0):
    return spark.createDataFrame([(source, v, extra) for v in values], "src string, v int, part int")


def content(spark, path, number=None):
    return sorted((r.source, r.v) for r in V.read(spark, path, number).select("source", "v").collect())


def test_replace_and_delete_by_source(spark, path):
    assert V.replace(rows(spark, "a", [1, 2]).union(rows(spark, "b", [3])), path, "src") == (1, 0, 3)
    seen = V.read(spark, path)  # a reader in between
    assert V.replace(rows(spark, "a", [7]), path, "src") == (2, 2, 1)
    assert sorted(r.v for r in seen.collect()) == [1, 2, 3]
    assert content(spark, path) == [("a", 7), ("b", 3)] and content(spark, path, 1) == [("a", 1), ("a", 2), ("b", 3)]
    assert V.delete(spark, path, ["b", "none"]) == (3, 1)
    assert content(spark, path) == [("a", 7)]
    gone = spark.createDataFrame([("a",), ("c",)], "source string")
    assert V.replace(rows(spark, "c", [9]), path, "src", sources=gone) == (4, 1, 1)
    assert content(spark, path) == [("c", 9)]
    assert V.replace(rows(spark, "c", []), path, "src") == (4, 0, 0)
    assert V.replace(rows(spark, "c", []), path, "src", sources=gone)[1:] == (1, 0) and content(spark, path) == []


def test_sources_that_look_like_numbers_and_further_partitions(spark, path):
    V.replace(rows(spark, "01", [1, 2]).union(rows(spark, "1", [3])), path, "src", ["part"])
    V.replace(rows(spark, "1", [4], 5), path, "src", ["part"])
    assert content(spark, path) == [("01", 1), ("01", 2), ("1", 4)]
    plan = V.read(spark, path).where("source = '1' and part = 5")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "(source#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_failed_writers_leave_the_old_rows(spark, path):
    V.replace(rows(spark, "a", [1]), path, "src")
    with pytest.raises(Exception, match="need a source"):
        V.replace(rows(spark, None, [5]).union(rows(spark, "a", [6])), path, "src")
    broken = rows(spark, "a", [5]).withColumn("v", F.when(F.col("v") == 5, F.raise_error(F.lit("boom"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="boom"):
        V.replace(broken, path, "src")
    assert content(spark, path) == [("a", 1)] and V.versions(spark, path) == [1]


def test_two_writers_at_once(spark, path, monkeypatch):
    V.replace(rows(spark, "a", [1]), path, "src")
    create, raced = V._create, []

    def late(spark_, path_, number, name, schema):
        if not raced:  # another writer publishes between this one's base and its commit
            raced.append(1)
            V.replace(rows(spark, "b", [2]), path, "src")
        return create(spark_, path_, number, name, schema)

    monkeypatch.setattr(V, "_create", late)
    assert V.replace(rows(spark, "a", [3]), path, "src")[0] == 3
    assert content(spark, path) == [("a", 3), ("b", 2)]
    assert shared_dir(spark)
