import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import jaccard_join as J
from millrace.llm.queries import op11_jaccard_join
from tests.llm.helpers import awkward, frame


def plain_sets(texts, width=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def plain_components(sets, percent=85):
    """Least index of each set's component by all pairs that share an n-gram."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, x in enumerate(sets):
        shared = Counter(j for g in x for j in holders.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(x) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in x:
            holders.setdefault(g, []).append(i)
    return [find(i) for i in range(len(sets))]


def check(spark, rows, **options):
    rows = sorted(rows)
    sets = plain_sets([t for _, t in rows])
    roots = plain_components(sets)
    want = [(i, len(x), rows[r][0]) for (i, _), x, r in zip(rows, sets, roots, strict=True)]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = sorted(map(tuple, J.link_components(docs, **options).collect()))
    assert got == want
    return sets, roots


def edited(rng, groups, sizes, copies, rate):
    """Groups of copies with some words changed, at similarities on both sides of the threshold."""
    rows, word = [], lambda: f"w{rng.randrange(30000)}"
    passage = [word() for _ in range(40)]
    for g in range(groups):
        base = [word() for _ in range(rng.choice(sizes))]
        if rng.random() < 0.4:
            base += passage
        for c in range(rng.choice(copies)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, int(len(w) * rate)) + 1)):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(k, word()), lambda: w.insert(k, word()), lambda: w.pop(k) if len(w) > 1 else None, lambda: w.append(word())])()  # noqa: B023
            rows.append((g * 10**4 + c, " ".join(w)))
    return rows


def test_query_against_brute_force(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    sets = plain_sets([t for _, t in rows])
    want = [(i, len(x), rows[r][0]) for (i, _), x, r in zip(rows, sets, plain_components(sets), strict=True)]
    assert sorted(map(tuple, op11_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect())) == want
    assert len({r[2] for r in want}) < len(want)


def test_edited_copies_of_all_sizes(spark):
    rng = random.Random(21)
    rows = edited(rng, 60, [3, 5, 8, 12, 15, 18, 22, 26, 30], [2, 5, 12], 0.06) + [(10**7 + i, t) for i, t in edited(rng, 25, [60, 150, 400], [2, 6, 25], 0.04)]
    sets, roots = check(spark, rows)
    assert len(rows) - len(set(roots)) > 100


def test_hub_of_copies_on_both_sides_of_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 64)  # lists are dealt over pairs of blocks
    monkeypatch.setattr(J, "ROUNDS", ((0, 2), (2, 1 << 60)))
    rng = random.Random(4)
    rows = edited(rng, 4, [80, 120], [150], 0.035)
    sets, roots = check(spark, rows)
    assert 10 < len(set(roots)) < len(rows) - 100


def test_prefixes_and_subsets_keep_every_link():
    rng = random.Random(2)
    for _ in range(3000):
        s = rng.randrange(1, 90)
        base = rng.sample(range(10**6), s + 12)
        a, drop = set(base[:s]), rng.randrange(0, max(1, s // 8) + 1)
        b = set(rng.sample(sorted(a), s - min(drop, s - 1))) | set(base[s : s + rng.randrange(0, max(1, s // 8) + 1)])
        if 100 * len(a & b) < 85 * len(a | b):
            continue
        assert len(a & b) >= J.need(len(a), len(b), 85) and len(b) >= J.least_partner(len(a), 85)
        first = [sorted(x)[: J.first_prefix(len(x), 85)] for x in (a, b)]
        rank = {g: rng.random() for g in a | b}
        second = [sorted(x, key=rank.get)[: J.second_prefix(len(y), 85)] for x, y in zip(first, (a, b), strict=True)]
        assert {*second[0]} & {*second[1]}
        if max(len(a), len(b)) <= 14:
            names = [{(c, x) for c in J.subset_sizes(len(y), 14, 85) for x in combinations(sorted(y), c)} for y in (a, b)]
            assert any(c >= J.need(len(a), len(b), 85) for c, _ in names[0] & names[1])


def test_a_pair_of_many_lists_is_told_in_the_least_one():
    """Three lists hold the same members, a fourth only two of them; every pair is told, each once."""
    rows = []
    members = {g: [1, 2, 3] for g in (-7, 5, 40)} | {2: [2, 4]}
    for g, ids in members.items():
        for i in ids:
            first = sorted(h for h, of in members.items() if i in of)[: J.FIRST]
            rows.append({"key": g, "n": 30, "id": i, "label": i, "sketch": bytes(J.BITS // 8), "most": 0, "g": g, "first": first})
    rows.sort(key=lambda r: (r["key"], r["n"], r["id"]))
    told = [(r["a"], r["b"]) for out in J._meet(iter(pa.Table.from_pylist(rows).to_batches()), 85, 0, 1 << 60) for r in out.to_pylist()]
    assert sorted(told) == [(1, 2), (1, 3), (2, 3), (2, 4)]
    # batches of one key's rows each
    by_key = [pa.RecordBatch.from_pylist([r for r in rows if r["key"] == g]) for g in sorted(members)]
    assert sum(out.num_rows for out in J._meet(iter(by_key), 85, 0, 1 << 60)) >= 4


def test_naming_a_subset_costs_more_than_scanning_an_entry():
    assert J.boundary({5: 10}, {5: 100}, 85) == 0
    assert J.boundary({5: 10}, {5: 100 * J.SUBSET}, 85) == 5


def test_boundary_follows_the_cost():
    assert J.boundary({}, {}, 85) == 0
    assert J.boundary({5: 10, 20: 10}, {5: 1000, 20: 1000}, 85) == 5  # subsets of 20 are too many
    assert J.boundary({5: 10, 20: 10}, {5: 1000, 20: 10**7}, 85) == 20
    assert J.boundary({5: 10}, {5: 1}, 85) == 0


def test_awkward_rows_and_empty_table(spark):
    docs = frame(spark, awkward([(None, "Nobody Knows this row", "en", "c", 1), (11, "one", "en", "c", 1), (12, "ONE\n", "en", "c", 1)]))
    clash = docs
    for name in ("n", "K1", "row", "label", "component", "low", "copies", "t1", "prefix", "id", "doc", "body", "g", "c0"):
        clash = clash.withColumn(name, F.lit(name))
    out = J.link_components(clash, keep=clash.columns, prefix="x_").collect()
    assert len(out) == 13 and all(r.n == "n" and r.c0 == "c0" for r in out)
    got = {(r.doc_id, r.text): (r.x_n_shingles, r.x_component_id) for r in out}
    assert got[1, awkward()[0][1]] == got[2, awkward()[0][1]] == (8, 1)
    assert got[3, None] == (0, 3) and got[4, ""] == (0, 4) and got[5, " \t\n "] == (0, 5)
    assert got[11, "one"] == got[12, "ONE\n"] == (1, 11)
    assert {r.x_component_id for r in out if r.doc_id is None} == {None}
    assert J.link_components(docs.limit(0)).count() == 0
    try:
        J.link_components(docs.withColumn("N_Shingles", F.lit(1)), keep=["N_Shingles"])
        raise AssertionError
    except ValueError:
        pass


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 300, np.uint64))
    y = np.union1d(x[20:], rng.integers(0, 1 << 63, 9, np.uint64))
    bits = lambda s: np.bincount((s % np.uint64(J.BITS)).astype(np.int64), minlength=J.BITS) & 1
    assert (bits(x) ^ bits(y)).sum() <= len(np.setxor1d(x, y))
