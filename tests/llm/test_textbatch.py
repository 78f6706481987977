"""Arrow batches of bounded bytes, and workers that give free memory back."""

import pyarrow as pa

from millrace.llm import textbatch
from millrace.plans.materialize import ARROW_BYTES, materialize


def test_batches_of_long_rows_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    before = spark.conf.get(ARROW_BYTES, None)
    long_ = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('x', 4000) AS text")
    found = materialize(long_.mapInArrow(textbatch.trimmed(sizes), "n long, size long"), batch_bytes=1 << 20).collect()
    assert sum(r.n for r in found) == 6000 and max(r.size for r in found) < 1.2 * (1 << 20)
    assert spark.conf.get(ARROW_BYTES, None) == before


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    calls = []
    monkeypatch.setattr(textbatch, "release", lambda: calls.append(len(calls)))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    assert list(textbatch.trimmed(lambda it: it)(iter([batch, batch]))) == [batch, batch] and calls == [0]
    monkeypatch.setattr(textbatch, "TRIM_SECONDS", -1.0)
    assert list(textbatch.trimmed(lambda it: it)(iter([batch, batch]))) == [batch, batch] and len(calls) == 4
    assert list(textbatch.trimmed(lambda it: it)(iter([]))) == [] and len(calls) == 5


def test_release_runs_anywhere():
    textbatch.release()
