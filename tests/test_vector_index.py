"""The inverted-file index against brute force: exact results by bounds, recall by candidates, filters of any selectivity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import vector_index as V
from millrace.sources import tables as S
from millrace.sources import versioned

DIM = 16


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, DIM))
    x = np.concatenate([centers[rng.integers(0, 30, 4000)] + 0.4 * rng.normal(size=(4000, DIM)), rng.normal(size=(1000, DIM))])
    rows = [(i, v.tolist(), i % 100, i % 1000) for i, v in enumerate(x)]
    odd = [(9000, None, 1, 1), (9001, [0.0] * DIM, 1, 1), (9002, [1.0], 1, 1), (9003, [float("nan")] * DIM, 1, 1)]
    items = spark.createDataFrame(rows + odd, "id int, embedding array<double>, pct int, mil int")
    path = f"file://{tmp_path_factory.mktemp('ivf')}/index"
    assert V.write_index(items, path, DIM)[2] == 5000
    queries = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(0, 5000, 125)] + [(-1, [0.0] * DIM)], "query_id int, vector array<double>")
    return items, path, queries, x


def brute(x, keep, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[q]
    ids = np.flatnonzero(keep)
    return ids[np.lexsort((ids, -np.round(s[ids], 12)))][:k].tolist()


def collect(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_exact_search_equals_brute_force(spark, index, monkeypatch):
    _, path, queries, x = index
    monkeypatch.setattr(V, "BLOCK", 64)
    for where, keep in ((None, np.ones(5000, bool)), (F.col("mil") == 7, np.arange(5000) % 1000 == 7)):
        got = collect(V.search(spark, path, queries, 10, where=where, candidates=50, exact=True))
        assert got == {q: brute(x, keep, q, 10) for q in range(0, 5000, 125)}


def test_recall_at_all_selectivities_and_share_of_rows_read(spark, index):
    _, path, queries, x = index
    for where, keep, most in ((None, np.ones(5000, bool), 0.4), (F.col("pct") == 3, np.arange(5000) % 100 == 3, 1.0), (F.col("mil") == 3, np.arange(5000) % 1000 == 3, 1.0)):
        got = collect(V.search(spark, path, queries, 10, where=where))
        want = {q: brute(x, keep, q, 10) for q in range(0, 5000, 125)}
        recall = sum(len({*got[q]} & {*want[q]}) for q in want) / sum(map(len, want.values()))
        share = V.share_read(spark, path, queries, 10, where).agg(F.avg("share")).first()[0]
        assert recall >= 0.9 and share <= most, (recall, share)
    assert V.search(spark, path, queries, 10, where=F.col("pct") == 1000).count() == 0


def test_cells_prune_and_sources_are_replaced(spark, index, tmp_path):
    items, path, _, _ = index
    plan = versioned.read(spark, path).where("cell = 3")._jdf.queryExecution().toString()
    assert "(cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    mine = f"file://{tmp_path}/index"
    V.write_index(items.where("id < 500"), mine, DIM, source=F.concat(F.lit("s"), F.col("pct") % 2))
    one = spark.createDataFrame([(1, [1.0] + [0.0] * (DIM - 1))], "query_id int, vector array<double>")
    new = spark.createDataFrame([(7777, [1.0] + [0.0] * (DIM - 1), 1, 1)], "id int, embedding array<double>, pct int, mil int")
    assert V.write_index(new, mine, DIM, source=F.lit("s1")) == (2, 250, 1)
    assert collect(V.search(spark, mine, one, 1)) == {1: [7777]}
    assert V.search(spark, mine, one, 5, sources=["s1"]).count() == 1


def test_synthetic_items_are_searched_by_rare_users(spark, tmp_path):
    items = S.synthetic_items(spark, 3000, 8, 0.01)
    path = f"file://{tmp_path}/index"
    V.write_index(items, path, 8)
    q = spark.createDataFrame([(1, [1.0] * 8)], "query_id int, vector array<double>")
    found = V.search(spark, path, q, 10, where=F.col("user_id") == "rare_user", exact=True)
    assert found.count() == min(10, items.where("user_id = 'rare_user'").count())
