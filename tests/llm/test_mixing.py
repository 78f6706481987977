import math

from pyspark.sql import functions as F

from millrace.llm import mixing
from tests.llm.helpers import awkward, frame


def test_inverse_poisson(spark):
    rates = [0.0, 0.3, 2.0, 40.0, 900.0, 1e6]
    table = mixing.poisson_table(spark.createDataFrame([(str(r), r) for r in rates], "source string, rate double")).collect()
    for rate in rates:
        rows = sorted({(r.k, r.low, r.high) for r in table if r.source == str(rate)})
        if not rate:
            assert rows == []
            continue
        assert len(rows) < 20 * math.sqrt(rate) + 90 and rows[0][1] == 0 and rows[-1][2] > 1
        assert all(x[2] == y[1] for x, y in zip(rows, rows[1:], strict=False))
        high = {k: h for k, _, h in rows}
        for k in (0, 1, int(rate), int(rate + 3 * math.sqrt(rate))):
            if k in high and k < rows[-1][0]:
                want = math.fsum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(k + 1))
                assert abs(high[k] - want) < 1e-9
        # every bucket has the rows whose steps reach into it
        for k, low, top in rows[:: max(1, len(rows) // 50)]:
            buckets = {r.bucket for r in table if r.source == str(rate) and r.k == k}
            assert buckets == set(range(min(255, int(low * 256)), min(255, int(top * 256)) + 1))


def test_large_rates_take_no_array_and_ranges_are_even(spark):
    docs = frame(spark, [(1, "x", "en", "rare", 1), *[(i, "y" * 2_000, "en", "big", 1) for i in range(2, 502)]])
    out = mixing.replicate(docs, keep=["doc_id"])
    n = out.where("doc_id = 1").count()
    assert abs(n - 250_000) < 5_000  # half of all bytes by a text of two
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * sum(sizes) / 8  # ranges are sampled


def test_sources_meet_their_weights_and_runs_agree(spark):
    rows = [(i, "x" * (20 + i % 60), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(6000)]
    docs = frame(spark, rows)
    out = mixing.replicate(docs, {"hot": 2.0})
    size = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    total = sum(len(r[1]) + 1 for r in rows)
    for source, n in size.items():
        assert abs(n / total - (2 if source == "hot" else 1) / 9) < 0.02, source
    again = mixing.replicate(docs.repartition(3), {"hot": 2.0})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert {r.copy_no for r in out.where("copies = 2").collect()} == {1, 2}


def test_output_is_in_random_order(spark):
    docs = frame(spark, [(i, "text", "en", "s", 4) for i in range(3000)])
    ids = [r.doc_id for r in mixing.replicate(docs).collect()]
    steps = sum(a < b for a, b in zip(ids, ids[1:], strict=False))
    assert abs(steps / len(ids) - 0.5) < 0.05


def test_awkward_rows_empty_table_and_clashes(spark):
    docs = frame(spark, awkward())
    out = mixing.replicate(docs, epochs=5.0)
    assert {r.source for r in out.collect()} == {"a", "b", "c", None}
    assert mixing.replicate(docs.limit(0)).count() == 0
    clash = docs.withColumn("copies", F.lit("mine"))
    assert "m_copies" in mixing.replicate(clash, prefix="m_").columns
    assert mixing.replicate(docs, {"a": 0.0}).where("source = 'a'").count() == 0
