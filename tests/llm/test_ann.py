import numpy as np
from pyspark.sql import functions as F

from millrace.llm import ann
from millrace.llm.queries import op2_nearest
from tests.llm.helpers import frame


def exact(ids, x, queries, k=5):
    out = {}
    for i in queries:
        scores = sorted((-float(ann.cosine(x[j : j + 1], x[i])[0]), int(ids[j])) for j in range(len(ids)) if j != i)
        out[int(ids[i])] = [(v, -s) for s, v in scores[:k]]
    return out


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = exact(ids, x, np.flatnonzero(ids % 50 == 0))
    got = {}
    for r in op2_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    truth = dict(zip(ids.tolist(), x, strict=True))
    for q, found in got.items():
        for v, s in found:
            a, b = truth[q], truth[v]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-14


def test_probes_come_in_order_of_cost():
    inside = np.array([0.1, 0.5, 0.8])
    costs = [sum(inside[k] ** 2 if s < 0 else (1 - inside[k]) ** 2 for k, s in p) for p in ann.probe_order(inside, 27)]
    assert costs == sorted(costs) and len(costs) == 27


def test_copies_ties_and_salted_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLOT_ROWS", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, [float(v) for v in base]) for i in range(30)] + [(100 + i, [float(v) for v in base + rng.standard_normal(8) * 0.001]) for i in range(60)]
    rows += [(300 + i, [float(v) for v in rng.standard_normal(8)]) for i in range(30)]
    got = {}
    for r in ann.nearest(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[20] == [0, 1, 2, 3, 4]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    want = exact(ids, x, np.flatnonzero(ids % 10 == 0))
    hits = sum(len(set(got[q]) & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_unusable_vectors_few_rows_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (50, [0.0, 3.0]), (8, [1.0]), (0, [2.0, 0.0])]
    docs = frame(spark, rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("slot", F.lit(1))
    out = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(docs, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(out)[-3:] == [(50, 1, 1, 0.707107), (50, 2, 0, 0.0), (50, 3, 0, 0.0)]
    assert sum(q == 0 for q, *_ in out) == 6  # two rows of id 0, three others each
    assert ann.nearest(docs.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(frame(spark, rows[:1], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert ann.nearest(docs, F.lit(False)).count() == 0
