"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing and sharding of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and
reads it again for the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm import decontaminate, langid, mixing, sharding, simhash
from millrace.llm.columns import free_prefix
from millrace.llm.queries import MIX_WEIGHTS
from millrace.plans.materialize import materialize


#: Languages of the corpus, and the least score of a prediction: the share of the decided language among a text's known n-grams.
LANGUAGES, LEAST_SCORE = ("de", "en", "es", "fr"), 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that aren't clearly in one of LANGUAGES: null texts, texts without a letter, of unknown n-grams, in another
    language, and mixtures in which no language has LEAST_SCORE of the n-grams."""
    model = langid.fit(docs, F.lit(True))
    p = free_prefix(docs.columns, ["lang_pred", "score"], "stage_")
    found = langid.identify(docs, model, prefix=p)
    return found.where(F.col(f"{p}lang_pred").isin(*LANGUAGES) & (F.col(f"{p}score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of texts at a Jaccard similarity of 0.8 or more (of rows with equal
    ids, one)."""
    p = free_prefix(docs.columns, ["row", "n", "component", "component_id"], "stage_")
    row, n = f"{p}row", f"{p}n"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = simhash.similar_texts(numbered, keep=["doc_id", row], prefix=p)
    # row_number with a bound of 1 is cut down in each task before the shuffle, so a large component is no hot key
    first = W.Window.partitionBy(f"{p}component").orderBy(F.col("doc_id").asc_nulls_last(), row)
    kept = found.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(row)
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item is verified. Null and empty texts hold none; rows that repeat are decided alike; all
    columns stay, whatever their names."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents by their source's target rate and shuffle all of them. Rows of one id get one count, a null source is one of
    the sources, null texts have a size of 1; all columns stay, whatever their names."""
    p = free_prefix(docs.columns, ["copies", "copy_no", "mix_key"], "stage_")
    return mixing.replicate(docs, MIX_WEIGHTS, prefix=p).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal documents to eight shards of near equal bytes, equal texts together; columns that have these names are named ``new_``."""
    return sharding.shard_texts(docs, 8, prefix=free_prefix(docs.columns, ["shard", "slot"]))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]

#: No stage but mixing can be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
