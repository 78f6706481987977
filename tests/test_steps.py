"""Policies of steps: failures, time limits, cancellation."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.plans.steps import run_steps

def add(n):
    return lambda d: d.withColumn("x", F.col("x") + n)


def fails(d):
    return d.withColumn("x", F.raise_error(F.lit("boom")).cast("long"))


def hangs(d):
    return d.withColumn("x", F.udf(lambda x: time.sleep(60) or x, "long")("x"))


def told(status):
    return [(r.step, r.status, (r.error or "")[:7]) for r in status.collect()]


def values(table):
    return sorted(r.x for r in table.select("x").collect())


def test_steps_in_turn(spark):
    df = spark.range(3).withColumnRenamed("id", "x")
    tables, status = run_steps(df, [("a", add(1)), ("b", add(10))])
    assert values(tables["b"]) == [11, 12, 13] and told(status) == [("a", "success", ""), ("b", "success", "")]
    tables, status = run_steps(df, [("a", add(1)), ("bad", fails), ("c", add(5))])
    assert [*tables] == ["a"] and [x[:2] for x in told(status)] == [("a", "success"), ("bad", "failed")]
    tables, status = run_steps(df, [("a", add(1)), ("bad", fails), ("none", lambda d: 5), ("c", add(5))], "fail_tolerant")
    assert values(tables["c"]) == [6, 7, 8] and [x[1] for x in told(status)] == ["success", "failed", "failed", "success"]
    with pytest.raises(ValueError, match="policy"):
        run_steps(df, [], "any")
    assert run_steps(df, [])[1].count() == 0


def test_a_step_that_hangs_is_cancelled_and_the_others_finish(spark):
    df = spark.range(3).withColumnRenamed("id", "x")
    began = time.monotonic()
    tables, status = run_steps(df, [("a", add(1)), ("stuck", hangs), ("bad", fails), ("c", add(2))], "parallel", 12.0)
    assert time.monotonic() - began < 40
    assert {*tables} == {"a", "c"} and values(tables["c"]) == [2, 3, 4]
    assert dict((r.step, r.status) for r in status.collect()) == {"a": "success", "stuck": "failed", "bad": "failed", "c": "success"}
    assert [r.error for r in status.collect() if r.step == "stuck"] == ["timeout"]
    for _ in range(100):  # its job is gone
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
