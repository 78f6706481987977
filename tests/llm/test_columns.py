"""Every operator on a table whose further columns have the names that operators use, in either letter case."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, jaccard_join, langid, lines, mixing, passages, repeats, secrets, sharding, simhash
from tests.llm.helpers import awkward, frame

MODULES = (decontaminate, jaccard_join, langid, lines, mixing, passages, repeats, secrets, sharding, simhash)
NAMES = sorted({n for m in MODULES for n in re.findall(r'"(_{0,2}[a-z][a-z0-9_]{0,14})"', open(m.__file__).read())} - {"doc_id", "text", "lang", "source", "n_chars"})


def operators(docs):
    items = docs.sparkSession.createDataFrame([(1, "the cat sat on the mat and looked at the moon")], "item_id int, text string")
    return {
        "repeats": lambda d, **k: repeats.remove_repeats(d, **k),
        "passages": lambda d, **k: passages.near_passages(d, **k),
        "decontaminate": lambda d, **k: decontaminate.contaminated_pairs(d, items, **k),
        "sharding": lambda d, **k: sharding.shard_texts(d, **k),
        "lines": lambda d, **k: lines.dedup_lines(d, **k),
        "simhash": lambda d, **k: simhash.near_duplicates(d, **k),
        "similar": lambda d, **k: simhash.similar_texts(d, **k),
        "langid": lambda d, **k: langid.identify(d, langid.fit(docs, F.lit(True)), **k),
        "secrets": lambda d, **k: secrets.scan(d, **k),
        "mixing": lambda d, **k: mixing.replicate(d, **k),
        "jaccard": lambda d, **k: jaccard_join.link_components(d, **k),
    }


@pytest.mark.parametrize("case", [str.lower, str.upper])
@pytest.mark.parametrize("name", ["repeats", "passages", "decontaminate", "sharding", "lines", "simhash", "similar", "langid", "secrets", "mixing", "jaccard"])
def test_columns_of_any_name_pass_through(spark, name, case):
    docs = frame(spark, awkward())
    clash = docs.select("*", *[F.lit(n).alias(case(n)) for n in NAMES])
    out = operators(docs)[name](clash, keep=clash.columns, prefix="zz_")
    rows = out.collect()
    assert out.columns[: len(clash.columns)] == clash.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    assert all(r[case(n)] == n for r in rows for n in NAMES) and (rows or name == "decontaminate")
    new = [c for c in out.columns if c not in clash.columns][0].removeprefix("zz_")
    with pytest.raises(ValueError, match="give a prefix"):
        operators(docs)[name](docs.withColumn(case(new), F.lit(1)), keep=["doc_id", case(new)])


@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_stages_keep_columns_of_any_name(spark, tmp_path, case):
    docs = frame(spark, awkward())
    spark.createDataFrame([(1, "the cat sat on the mat and looked at the moon")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["__row", "stage_row", "__score", "stage_score", "__copies", "stage_copies", "row", "n", "shard", "slot", "component", "fp", "low", "root"]
    clash = docs.select("*", *[F.lit(n).alias(case(n)) for n in names])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, str(tmp_path))
        assert out.columns[: len(clash.columns)] == clash.columns
        assert all(r[case(n)] == n for r in out.collect() for n in names)
