"""The event table's stream: offsets, restarts, gaps."""

import pytest
from pyspark.sql import functions as F

from millrace.streaming import source as E
from millrace.streaming.events import to_table

SCHEMA = "sequence_num long, kind string, value double"


def events(spark, first, last):
    return spark.range(first, last + 1).select(F.col("id").alias("sequence_num"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind"), (F.col("id") / 2).alias("value"))


def drain(spark, tmp_path, name="out", **options):
    stream = E.read_event_table(spark, f"file://{tmp_path}/events", SCHEMA, **options)
    to_table(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-c").awaitTermination()
    return sorted(r.sequence_num for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/{name}").collect())


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    assert E.append_events(events(spark, 0, 9), path) == (0, 9)
    assert E.append_events(events(spark, 10, 24), path) == (10, 24)
    assert drain(spark, tmp_path) == list(range(25))
    assert drain(spark, tmp_path) == list(range(25))
    E.append_events(events(spark, 25, 30), path)
    assert drain(spark, tmp_path) == list(range(31))
    assert drain(spark, tmp_path, "late", start="20") == list(range(20, 31))
    got = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").where("sequence_num = 7").first()
    assert tuple(got) == (7, "k1", 3.5)


def test_a_failed_sink_is_retried_from_the_same_offset(spark, tmp_path):
    E.append_events(events(spark, 0, 19), f"file://{tmp_path}/events")
    seen = []

    def sink(fail):
        def run(rows, epoch):
            found = sorted(r.sequence_num for r in rows.collect())
            if fail:
                raise RuntimeError("sink")
            seen.append((epoch, found))

        return run

    for fail in (True, False):
        query = E.read_event_table(spark, f"file://{tmp_path}/events", SCHEMA).writeStream.foreachBatch(sink(fail)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        if fail:
            with pytest.raises(Exception, match="sink"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert seen == [(0, list(range(20)))]


def test_gaps(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    E.append_events(events(spark, 0, 4), path)
    E.append_events(events(spark, 8, 9), path)
    assert drain(spark, tmp_path, "wait") == [0, 1, 2, 3, 4]
    assert drain(spark, tmp_path, "skip", gaps="skip") == [0, 1, 2, 3, 4, 8, 9]
    with pytest.raises(Exception, match="events 5 to 7 are missing"):
        drain(spark, tmp_path, "fail", gaps="fail")
    E.append_events(events(spark, 5, 7), path)
    assert drain(spark, tmp_path, "wait") == list(range(10))


def test_what_may_be_appended(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    assert E.append_events(events(spark, 0, 4), path) == (0, 4)
    for bad in (events(spark, 3, 6), events(spark, 7, 9).union(events(spark, 9, 9)), events(spark, 7, 9).where("sequence_num <> 8")):
        with pytest.raises(ValueError, match="sequence numbers"):
            E.append_events(bad, path)
    assert E.append_events(events(spark, 5, 4), path) is None
    assert drain(spark, tmp_path) == [0, 1, 2, 3, 4]


def test_many_batches_are_written_by_one_job_and_share_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    rows = events(spark, 0, 499).withColumn("batch", F.floor(F.col("sequence_num") / 5))
    assert E.append_batches(rows, path, "batch") == [(a, a + 4) for a in range(0, 500, 5)]
    reader = E.EventReader(spark.createDataFrame([], SCHEMA).schema, path, 0, "wait", "sequence_num")
    assert len(reader.partitions({"next": 0}, {"next": 500})) == 1
    assert drain(spark, tmp_path) == list(range(500))
    with pytest.raises(ValueError, match="495 to 499"):
        E.append_batches(events(spark, 495, 504).withColumn("batch", F.floor(F.col("sequence_num") / 5)), path, "batch")
    with pytest.raises(ValueError, match="500 to 509"):
        E.append_batches(events(spark, 500, 509).where("sequence_num <> 504").withColumn("batch", F.lit(0)), path, "batch")
    assert E.append_batches(rows.limit(0), path, "batch") == []
    assert E.append_batches(events(spark, 500, 502).withColumn("batch", F.lit(7)), path, "batch") == [(500, 502)]
    assert drain(spark, tmp_path) == list(range(503))
