import numpy as np
from pyspark.sql import functions as F

from millrace.llm import decontaminate as D
from millrace.llm.queries import op4_decontaminate
from tests.llm.helpers import awkward, frame

ITEMS = "item_id long, text string"


def plain_pairs(docs, items, similarity=0.8):
    """Every item against every run of words of its length and some more, without an index."""
    found = set()
    for i, text in docs:
        words = D.words_of(text)
        for j, item in items:
            iw = D.words_of(item)
            if not iw:
                continue
            width, whole, q, a = D.overlap_sets(iw)
            everywhere = D.shingles(words, width)
            if len(whole & everywhere) / len(whole) < similarity:
                continue
            for at in range(0, max(1, len(words)), 8):
                seen = D.shingles(words[at : at + len(iw) + 40], width)
                if len(whole & seen) / len(whole) >= similarity and (q & seen or not q) and (a & seen or not a):
                    found.add((i, j))
                    break
    return found


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in op4_decontaminate(spark, sf).collect()}
    assert got == plain_pairs(docs, items) and got


def test_block_max_bound_misses_no_passage():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [{"item": i, "part": 0, "words": [vocabulary[k] for k in rng.integers(0, 60, 20)]} for i in range(50)]
    freq = {}
    for r in rows:
        for w in set(r["words"]):
            freq[w] = freq.get(w, 0) + 1
    index = D._index(rows, freq, len(rows), 20.0)
    texts = [" ".join(vocabulary[k] for k in rng.integers(0, 60, n)) for n in (3, 40, 70, 200, 500)]
    # score every passage against every item straight from the postings
    want = set()
    half = D.PASSAGE // 2
    for i, text in enumerate(texts):
        words = text.split()
        for at in range(0, max(1, len(words)), half):
            terms = {index.terms[w] for w in words[at : at + D.PASSAGE] if w in index.terms}
            score = np.zeros(50)
            for t in terms:
                a, b = index.post_at[t : t + 2]
                score[index.post_part[a:b]] += index.post_impact[a:b]
            want |= {(i, int(j), round(float(score[j]), 9)) for j in np.flatnonzero(score >= 0.5)}
    got = {(i, j, round(s, 9)) for i, j, s, *_ in D.matches(index, texts, 0.5)}
    assert got == want and got


def test_edited_and_long_items(spark):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(f"q{k}" for k in rng.integers(0, 5000, n))
    short, long, other = word(40), word(300), word(50)
    edited = short.split()
    edited[20] = "changed"
    rows = [
        (1, f"{word(77)} {short} {word(300)}", "en", "s", 1),
        (2, f"{word(100)} {' '.join(edited).upper()}!", "en", "s", 1),
        (3, f"{word(10)} {long} {word(99)}", "en", "s", 1),
        (4, f"{word(50)} {' '.join(short.split()[:20])} {word(40)}", "en", "s", 1),
        (5, word(4000), "en", "s", 1),
        (6, "of Two words only", "en", "s", 1),
    ]
    items = frame(spark, [(1, short), (2, long), (3, other), (4, None), (5, ""), (6, short), (7, "two words")], ITEMS)
    docs = frame(spark, rows)
    pairs = {(r.doc_id, r.item_id) for r in D.contaminated_pairs(docs, items, ["doc_id"]).collect()}
    assert pairs == {(1, 1), (1, 6), (2, 1), (2, 6), (3, 2), (6, 7)}
    assert {r.doc_id for r in D.clean(docs, items).collect()} == {4, 5}


def test_repeated_rows_null_ids_and_other_types(spark):
    item = " ".join(f"q{k}" for k in range(16))
    other = " ".join(f"z{k}" for k in range(20))
    docs = frame(spark, [(1, f"before it {item} after it", "en", "s", 1), (2, f"{other} and so on", "en", "s", 1), (3, "nothing of them", "en", "s", 1)])
    items = frame(spark, [(7, item), (7, item), (None, other), (None, item), (7, other)], ITEMS)
    pairs = sorted(((r.doc_id, r.item_id) for r in D.contaminated_pairs(docs, items, ["doc_id"]).collect()), key=repr)
    assert pairs == sorted([(1, 7), (1, 7), (1, None), (2, None), (2, 7)], key=repr)
    assert [r.doc_id for r in D.clean(docs, items).collect()] == [3]
    for kind in ("string", "int", "double", "decimal(10,2)", "date"):
        typed = items.withColumn("item_id", F.lit("2020-01-01").cast(kind) if kind == "date" else F.col("item_id").cast(kind))
        out = D.contaminated_pairs(docs, typed, ["doc_id"])
        assert dict(out.dtypes)["item_id"] == kind and out.count() == 5
    clash = docs.withColumn("score", F.lit("mine"))
    out = D.contaminated_pairs(clash, items, ["doc_id", "score"], prefix="p_")
    assert {r.score for r in out.collect()} == {"mine"} and "p_item_id" in out.columns
    try:
        D.contaminated_pairs(clash, items, ["score"])
    except ValueError:
        pass
    else:
        raise AssertionError


def test_several_indexes_agree_with_one(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, D.contaminated_pairs(docs, items, ["doc_id"]).collect()))
    monkeypatch.setattr(D, "INDEX_WORDS", 400)
    assert len(D.build_indexes(items)) > 2
    assert sorted(map(tuple, D.contaminated_pairs(docs, items, ["doc_id"]).collect())) == one


def test_awkward_rows_empty_tables_and_clashes(spark):
    docs = frame(spark, awkward()).withColumn("score", F.lit("mine")).withColumn("item", F.lit(3))
    items = frame(spark, [(1, "the cat sat on the mat and looked at the moon")], ITEMS)
    assert D.clean(docs, items).count() == 7
    assert D.contaminated_pairs(docs, items, ["doc_id", "item"]).count() == 3
    assert D.clean(docs, items.limit(0)).count() == 10 and D.clean(docs.limit(0), items).count() == 0
    assert D.contaminated_pairs(docs, items.limit(0), ["doc_id"]).count() == 0
