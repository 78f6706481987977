from collections import Counter
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.queries import op7_simhash
from tests.llm.helpers import awkward, frame


def plain_fingerprint(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(fps, 4)
    want = {(d, f"{f:016x}", docs[r][0]) for (d, _), f, r in zip(docs, fps, roots, strict=True)}
    assert {tuple(r) for r in op7_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want
    assert len({r for r in roots}) < len(docs)


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(5)
    fps = []
    for size in (1, 2, 70, 400):
        base = rng.getrandbits(64)
        for _ in range(size):
            f = base
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    fps = sorted({*fps, 0, 1, (1 << 64) - 1})
    roots = plain_components(fps, 4)
    for n_hint in (None, 10**9):  # short and long bucket keys agree
        old = simhash._pieces_of
        if n_hint:
            simhash._pieces_of = lambda n, r: old(n_hint, r)
        try:
            signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
            from millrace.operators.components import component_labels

            labels = {r.node: r.label for r in component_labels(simhash.link_fingerprints(frame(spark, signed, "fp long"), 4)).collect()}
        finally:
            simhash._pieces_of = old
        got = {}
        for (s,), r in zip(signed, roots, strict=True):
            got.setdefault(r, set()).add(labels.get(s, s))
        assert all(len(x) == 1 for x in got.values()) and len({next(iter(x)) for x in got.values()}) == len(got)


def test_large_buckets_are_dealt_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    fps = [(i,) for i in range(1 << 7)]
    links = simhash.link_fingerprints(frame(spark, fps, "fp long"), 1)
    from millrace.operators.components import component_labels

    assert {r.label for r in component_labels(links).collect()} == {0}


def test_awkward_rows_and_empty_table(spark):
    docs = frame(spark, awkward())
    out = simhash.near_duplicates(docs, keep=["doc_id", "text"]).collect()
    assert len(out) == 10
    assert {r.component_id for r in out if r.text and r.text.startswith("The cat")} == {1}
    blank = [r for r in out if not (r.text or "").strip()]
    assert {r.fingerprint for r in blank} == {"0" * 16} and {r.component_id for r in blank} == {3}
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    clash = docs.withColumn("fingerprint", F.lit(1)).withColumn("component_id", F.lit("x"))
    assert simhash.near_duplicates(clash, keep=clash.columns, prefix="s_").count() == 10


def plain_similar(texts, width=5, similarity=0.8):
    """Least index of each text's component by exact Jaccard similarity of all pairs that share a shingle."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, x in enumerate(sets):
        shared = Counter(j for g in x for j in holders.get(g, ()))
        for j, n in [*shared.items(), *([(k, 0) for k in range(i) if not sets[k]] if not x else [])]:
            if n >= similarity * (len(x) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in x:
            holders.setdefault(g, []).append(i)
    return [find(i) for i in range(len(texts))]


def test_similar_texts_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    for group in range(40):  # edited copies at all similarities from 0.8 on
        base = [word() for _ in range(rng.randrange(20, 300))]
        for copy in range(rng.randrange(2, 30)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40) + 1)):
                w[rng.randrange(len(w))] = word()
            rows.append((10**6 + group * 100 + copy, " ".join(w)))
    want = plain_similar([t for _, t in rows])
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()}
    place = {i: k for k, (i, _) in enumerate(rows)}
    assert set(got) == set(place)
    for k, (i, _) in enumerate(rows):  # no class joins what is not connected
        assert want[place[got[i]]] == want[k]
    merges = len(rows) - len(set(want))
    assert merges > 300 and len(set(got.values())) - len(set(want)) <= 0.01 * merges, (len(set(got.values())), len(set(want)))


def test_similar_texts_awkward_rows(spark):
    docs = frame(spark, awkward([(None, "Nobody Knows this row", "en", "c", 1)])).withColumn("component", F.lit("x"))
    out = simhash.similar_texts(docs, prefix="p_").collect()
    ids = {r.doc_id: r.p_component_id for r in out}
    assert len(out) == 11 and ids[2] == 1 and ids[3] == ids[4] == ids[5] == 3 and ids[None] is None
    assert len({r.p_component for r in out if r.doc_id is None}) == 1
    assert simhash.similar_texts(docs.limit(0), prefix="p_").count() == 0


def test_no_pair_that_shares_a_band_is_lost(spark):
    import pyarrow as pa

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(9000)}"
    rows = []
    for group in range(4):  # hubs of copies on both sides of the threshold
        base = [word() for _ in range(rng.randrange(60, 160))]
        for copy in range(100):
            w = list(base)
            for _ in range(rng.randrange(0, len(base) // 22 + 2)):
                w[rng.randrange(len(w))] = word()
            rows.append((group * 1000 + copy, " ".join(w)))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["id", "t"])
    bands = [b for out in simhash._sketch(iter([batch]), 5, 8, 3) for b in out.column(2).to_pylist()]
    sets = [frozenset(np.concatenate(list(simhash.shingle_hashes(t, 5))).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) and {*bands[i]} & {*bands[j]}:
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()}
    assert links > 300 and [got[i] for i, _ in rows] == [rows[find(k)][0] for k in range(len(rows))]
