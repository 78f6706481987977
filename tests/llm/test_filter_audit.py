from collections import Counter
from itertools import permutations
import re

from pyspark.sql import functions as F

from millrace.llm import filter_audit, hotkeys
from millrace.llm.queries import op13_filter_audit
from tests.llm.helpers import awkward, frame

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    """All counts by walking each order document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append((i, part or "", f))
    out, shapley = [], Counter()
    for part in {p for _, p, _ in fails}:
        mine = [(i, f) for i, p, f in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                removed = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                shapley[part, c] += len(removed)
                fail = sum(c in f for _, f in mine)
                out.append((part, order, step, len(left), len(removed), fail - len(removed), sum(f == c for _, f in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert sorted(map(tuple, op13_filter_audit(spark, sf).collect())) == plain_audit(docs, labels)


def test_awkward_rows_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 1)
    monkeypatch.setattr(hotkeys, "SHARE", 0.4)  # a key of some rows is frequent, others are not
    rows = awkward([(9, "", "en", "a", 0), (10, "A $ B", "", "a", 5), (None, "The cat sat on the mat and looked at the moon", "de", "b", 1)])
    docs = frame(spark, rows).withColumn("mask", F.lit("x")).withColumn("id", F.lit(1.5)).withColumn("H", F.lit(0)).withColumn("part", F.lit(True)).withColumn("n", F.lit(2))
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (4, None, 1), (99, 1, 1)]
    told = frame(spark, labels, LABELS).withColumn("good", F.lit("y"))
    want = plain_audit([(r[0], r[1], r[2]) for r in rows], labels)
    assert sorted(map(tuple, filter_audit.audit(docs, told).collect())) == want
    assert {r[0] for r in want} == {"", "de", "en", "fr"}
    assert filter_audit.audit(docs.limit(0), told).count() == 0
    assert filter_audit.audit(docs, told.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_other_filters_and_numbers_of_them(spark):
    rows = frame(spark, [(m, "p") for m in (0, 1, 1, 2, 3)], "m int, p string")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.interactions(rows, "m", "p", "XY").collect()}
    assert got == {("XY", 1): (2, 3, 0, 2, 5), ("XY", 2): (1, 1, 1, 1, 3), ("YX", 1): (3, 2, 0, 1, 3), ("YX", 2): (1, 2, 1, 2, 5)}
