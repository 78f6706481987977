from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate as D
from millrace.llm import langid
from tests.llm.helpers import LONG, SCHEMA, awkward, frame
from tests.llm.test_decontaminate import plain_pairs
from tests.llm.test_simhash import plain_similar


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    roots = plain_similar([t for _, t in rows])
    assert sorted(r.doc_id for r in out.collect()) == sorted({rows[r][0] for r in roots})
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {i for i, _ in plain_pairs(rows, items)}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf).collect()} == {i for i, _ in rows} - dirty
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf).collect()}
    found = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs, F.lit(True)), keep=["doc_id"]).collect()}
    assert kept == {i for i, r in found.items() if r.lang_pred in corpus_pipeline.LANGUAGES and r.score >= 0.4}
    assert len(kept) >= 0.99 * len(found)


def test_language_rejects_what_is_in_none_clearly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {x: [r.text for r in docs.where(F.col("lang") == x).limit(3).collect()] for x in ("de", "en", "fr")}
    mixed = " ".join(w for three in zip(*(" ".join(t).split()[:200] for t in one.values()), strict=False) for w in three)
    extra = [(9001, mixed, "en", "s", 1), (9002, "1234 5678", "en", "s", 1), (9003, "\u4e2d\u6587\u6587\u672c", "zh", "s", 1), (9004, None, "en", "s", 1)]
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(frame(spark, extra)), sf).collect()}
    assert not left & {9001, 9002, 9003, 9004} and len(left) >= 0.99 * docs.count()


def test_columns_that_clash(spark, sf):
    docs = frame(spark, awkward(), SCHEMA)
    for name in ("shard", "slot", "copies", "copy_no", "mix_key", "component", "component_id", "lang_pred", "score"):
        docs = docs.withColumn(name, F.lit(name))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns or name == "shards"
        assert all(r.shard == "shard" and r.mix_key == "mix_key" for r in docs.collect())
    assert {"new_shard", "new_slot"} < {*docs.columns}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(out.columns)
    by_shard = Counter(r.shard for r in rows)
    assert len(by_shard) == 8
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in by_shard.items())


def test_awkward_rows_through_all_stages(spark, sf):
    docs = frame(spark, awkward([(20, LONG, "en", "b", 1)]), SCHEMA)
    kept = corpus_pipeline.language(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 7})
    unique = corpus_pipeline.near_duplicates(spark, kept, sf)
    ids = [r.doc_id for r in unique.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 20 not in ids and 6 in ids and None in ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert D.words_of("A-b") == ["a", "b"]
