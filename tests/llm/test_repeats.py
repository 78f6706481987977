import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm.queries import op1_repeats
from tests.llm.helpers import awkward, frame


def plain(texts, length):
    """Of each text: kept bytes' SHA-256, bytes removed and runs, from all strings of ``length`` bytes."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = defaultdict(int)
    for b in blobs:
        for i in range(len(b) - length + 1):
            seen[hash(b[i : i + length])] += 1
    out = []
    for b in blobs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, length=200, parts=1):
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(parts)
    rows = repeats.remove_repeats(docs, length=length, keep=["doc_id"]).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r in rows:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and len(r.removed) == r.n_spans
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(texts, plain(texts.values(), 200), strict=True))
    got = {r[0]: tuple(r)[1:] for r in op1_repeats(spark, sf).collect()}
    assert got == want and sum(w[1] for w in want.values())


@pytest.mark.parametrize("seed", range(4))
def test_families_of_edited_passages(spark, seed):
    rng = random.Random(seed)
    letters = "ab é漢" if seed % 2 else "abcdefghij klmno"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(rng.choice((199, 200, 201, 350, 700))) for _ in range(4)]
    texts = [None, "", make(199), make(5000)]
    for _ in range(40):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(passages))
            for _ in range(rng.randrange(3)):
                p[rng.randrange(len(p))] = rng.choice("xyzw")
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2)) if rng.random() < 0.3 else (0, len(p))
            text += make(rng.randrange(60)) + "".join(p[a:b])
        texts.append(text)
    texts += [texts[5], texts[5], "a" * 900, "ab" * 300, passages[0] * 3]
    assert run(spark, texts, parts=1 + 5 * (seed % 2)) == plain(texts, 200)


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    monkeypatch.setattr(repeats, "PIECE", 700)
    blob = text.encode()
    at, h = repeats._all_anchors(blob, 200)
    one, h1 = repeats.anchors(np.frombuffer(blob, np.uint8), 200)
    assert set(one) <= set(at) and dict(zip(one, h1, strict=True)).items() <= dict(zip(at, h, strict=True)).items()


def test_interval_tree():
    words = sorted(["abcx", "abcy", "abd", "ab", "xyz", "xyzz", "q"])
    lcp = [next((i for i, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), min(len(u), len(v))) for u, v in zip(words, words[1:], strict=False)]
    found = {(tuple(words[a:b]), c) for a, b, c in repeats.interval_tree(lcp, 1)}
    assert found == {(("abcx", "abcy"), 3), (("ab", "abcx", "abcy", "abd"), 2), (("xyz", "xyzz"), 3)}


def test_awkward_rows_empty_table_and_clashes(spark):
    docs = frame(spark, awkward()).withColumn("n_spans", F.lit("mine")).withColumn("k1", F.lit(0))
    out = repeats.remove_repeats(docs, prefix="r_").collect()
    assert len(out) == 10 and out[0].n_spans == "mine"
    assert {r.r_n_removed for r in out if r.text and r.text.startswith("The cat")} == {0}
    assert repeats.remove_repeats(docs.limit(0), prefix="r_").count() == 0
