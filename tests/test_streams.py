"""Stateful streams against their batch forms, with rows in any order."""

import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming import events as E

ROCKS = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(ROCKS, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(ROCKS)


def stream_of(spark, rows, schema, path, files):
    """The rows as a stream of small files, a file a batch, in the given order."""
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def collect(stream, path, mode="append"):
    found = []
    stream.writeStream.foreachBatch(lambda rows, epoch: found.extend(map(tuple, rows.collect()))).option("checkpointLocation", f"{path}/c").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return found


def test_shuffled_versions_end_like_the_batch(spark, tmp_path):
    rng = random.Random(2)
    schema = "thread long, key string, change long, expected long, value string"
    rows = [(t, k, 100 * v + c, v, f"v{v}.{c}") for t in range(2) for k in "ab" for v in range(8) for c in range(rng.choice([1, 1, 2]))]
    rows.append((0, "a", 5000, None, "none"))
    rows += [(7, "gap", 1, 3, "never"), (7, "gap", 2, 0, "first"), (7, "gap", 3, 1, "second")]
    rng.shuffle(rows)
    got = collect(E.fold_versions_stream(stream_of(spark, rows, schema, tmp_path, 3)), tmp_path, "update")
    want = {tuple(r)[:6]: r.version for r in E.fold_versions(spark.createDataFrame(rows, schema)).collect()}
    told = {r[:6] for r in got}
    # the least change of a version may come after another one of the same version has been applied; all else is equal
    versions = lambda rows: sorted((r[0], r[1], r[3]) for r in rows if r[5] == "applied")
    assert versions(told) == versions(want) and len(told) == len(got)
    assert (7, "gap", 1, 3, "never", "conflict") in {*want} and all(r[:6] not in told or r[5] == "conflict" for r in got if r[4] == "never")
    once = collect(E.fold_versions_stream(stream_of(spark, rows, schema, tmp_path / "once", 1)), tmp_path / "once", "update")
    assert {r[:6] for r in once} == {w for w in want if w[4] != "never"}  # what waits is not told


def test_changes_out_of_tries_are_conflicts(spark, tmp_path):
    schema = "thread long, key string, change long, expected long, value string"
    rows = [(1, "k", 9, 50, "early")] + [(1, "k", 10 + i, i, "x") for i in range(5)]
    got = collect(E.fold_versions_stream(stream_of(spark, rows, schema, tmp_path, 6), retries=3), tmp_path, "update")
    assert [r[5] for r in got if r[4] == "early"] == ["conflict"] and sum(r[5] == "applied" for r in got) == 5


def test_rate_limit_with_late_calls_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    times = sorted(rng.randrange(0, 900) for _ in range(240))
    calls = [(rng.choice("xy"), i, start + timedelta(seconds=t)) for i, t in enumerate(times)]
    order = sorted(range(len(calls)), key=lambda i: times[i] + rng.choice([0, 0, 0, 200]))  # some come late, within the watermark
    schema = "key string, call long, ts timestamp"
    stream = stream_of(spark, [calls[i] for i in order], schema, tmp_path, 6)
    got = {(k, c): a for k, c, _, a in collect(E.rate_limited_stream(stream, 4, 60, "5 minutes"), tmp_path)}
    want = {(r.key, r.call): r.allowed for r in E.rate_limited(spark.createDataFrame(calls, schema), ["key"], "ts", 4, 60).collect()}
    assert len(got) > 100 and all(want[k] == v for k, v in got.items()) and {*got.values()} == {True, False}
