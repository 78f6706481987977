"""Full-text search over a stored index: postings with positions, by lexeme bucket and source.

The index is a versioned table (``sources.versioned``), so a source's documents are replaced atomically. A query reads the buckets
of its lexemes only: partitions prune, and inside a bucket postings are sorted by lexeme, so Parquet skips row groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.stemming import STOP_WORDS, with_stems
from millrace.plans.materialize import broadcast_if_small, materialize, shuffle_parts, spread
from millrace.sources import versioned

#: Partitions of a source's postings by their lexeme's hash.
BUCKETS = 8
#: Words of letters and digits without stemming (BM25), or stemmed English without stop words (cover density).
PATTERNS = {"plain": "[a-z0-9]+", "english": r"[\p{L}\p{N}]+"}
#: Bytes of text whose postings a task sorts and writes.
PIECE = 4 << 20
#: Matched postings of which a task adds up the scores.
FOUND = 200_000
#: Words that a task puts in order at once.
SLICE = 1 << 20
#: Weight of a lexeme of the plain text in a cover's score.
WEIGHT = 0.1


def bucket(lexeme: Column | str) -> Column:
    return F.pmod(F.crc32(lexeme if isinstance(lexeme, Column) else F.col(lexeme)), F.lit(BUCKETS)).cast("int")


def _words(text: str, analyzer: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(PATTERNS[analyzer]), F.lit(0))


def _stemmed(rows: DataFrame, analyzer: str) -> DataFrame:
    """Rows with a ``word`` to rows with its ``lexeme``; stop words go."""
    if analyzer == "plain":
        return rows.withColumnRenamed("word", "lexeme")
    return with_stems(rows.where(~F.col("word").isin(STOP_WORDS)), "word", "lexeme").drop("word")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, id, words) to rows (word, held), some SLICE words at once: of each source, the documents with the word.

    ``ids`` and ``lens`` are the documents, ``tfs`` the number of places in each, ``positions`` all these places in a row. The
    documents' marks, the word ``""``, have no place.
    """
    for batch in batches:
        n = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // SLICE, prepend=0)).tolist()
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            count = n[low:high]
            coded, owner = part.column(2).flatten().dictionary_encode(), part.column(0).dictionary_encode()
            source, sources, words = owner.indices.to_numpy().astype(np.int64), len(owner.dictionary), len(coded.dictionary)
            row = np.repeat(np.arange(len(count)), count)
            key = coded.indices.to_numpy().astype(np.int64) * sources + source[row]
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1
            order = np.argsort(key, kind="stable")
            row, key, at = row[order], key[order], at[order]
            start = np.flatnonzero(_changes(row) | _changes(key))
            marks = np.argsort(source, kind="stable")
            tf = np.concatenate([np.diff(np.append(start, len(row))), np.zeros(len(marks), np.int64)])
            row, key = np.concatenate([row[start], marks]), np.concatenate([key[start], source[marks] + words * sources])
            start = np.flatnonzero(_changes(key))
            cut, key = np.append(start, len(key)), key[start]
            columns = [part.column(1).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (count[row], tf))]
            lists = [_lists(cut, c) for c in columns] + [_lists(np.append(0, np.cumsum(tf))[cut], pa.array(at.astype(np.int32)))]
            held = pa.StructArray.from_arrays([owner.dictionary.take(pa.array(key % sources)), *lists], names=["source", "ids", "lens", "tfs", "positions"])
            first = np.flatnonzero(_changes(key // sources))
            word = pa.concat_arrays([coded.dictionary, pa.array([""], pa.string())]).take(pa.array(key[first] // sources))
            yield pa.RecordBatch.from_arrays([word, _lists(np.append(first, len(key)), held)], names=["word", "held"])


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first one does."""
    return np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, lexeme, bucket, ids, lens, tfs, positions) of words to rows of ``postings``."""
    for batch in batches:
        source, lexeme, bucket_, ids, lens, tfs, positions = batch.columns
        n = ids.value_lengths().to_numpy(zero_copy_only=False)
        owner = pa.array(np.repeat(np.arange(batch.num_rows), n))
        tf = tfs.flatten()
        places = _lists(np.append(0, np.cumsum(tf.to_numpy(zero_copy_only=False))), positions.flatten())
        yield pa.RecordBatch.from_arrays([source.take(owner), ids.flatten(), lexeme.take(owner), bucket_.take(owner), tf, places, lens.flatten()], names=["source", "id", "lexeme", "bucket", "tf", "positions", "len"])


def _packed(docs: DataFrame, id_col: str, text: str, source: str, analyzer: str) -> DataFrame:
    """``postings`` with a source's documents of one word in a row; a word is stemmed once for SLICE words, without a shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = spread(docs).select(F.coalesce(F.col(source).cast("string"), F.lit("-")).alias("source"), F.col(id_col).alias("id"), _words(text, analyzer).alias("words"))
    blocks = docs.mapInArrow(_blocks, f"word string, held array<struct<source: string, ids: array<{id_type}>, lens: array<int>, tfs: array<int>, positions: array<int>>>")
    return _stemmed(blocks, analyzer).select("lexeme", F.inline("held")).select("source", "lexeme", bucket("lexeme").alias("bucket"), "ids", "lens", "tfs", "positions")


def _postings(packed: DataFrame) -> DataFrame:
    id_type = packed.schema["ids"].dataType.elementType.simpleString()
    return packed.mapInArrow(_unpacked, f"source string, id {id_type}, lexeme string, bucket int, tf int, positions array<int>, len int")


def postings(docs: DataFrame, id_col: str, text: str, source: str, analyzer: str = "english") -> DataFrame:
    """(source, id, lexeme, bucket, tf, positions, len): where each lexeme stands in each document, counted in words from 1.

    ``len`` is the document's number of words. Each document has a row with the lexeme ``""`` besides, so that statistics count it
    though it have no words. A document has a row for each of its words, so several with one lexeme if these words share it.
    Documents of one source are told apart by their id, which must be unique there.
    """
    return _postings(_packed(docs, id_col, text, source, analyzer))


def index_parts(docs: DataFrame, text: str, source: str) -> tuple[int, int]:
    """Partitions in which an index is written, and parts of a source's bucket: more text needs more of both, not larger sorts."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.octet_length(text)).alias("bytes")).agg(F.sum("bytes").alias("all"), F.max("bytes").alias("most")).first()
    return max(shuffle_parts(docs.sparkSession), -(-(sizes["all"] or 0) // PIECE)), max(1, -(-(sizes["most"] or 0) // (BUCKETS * PIECE)))


def write_index(docs: DataFrame, path: str, id_col: str = "id", text: str = "content", source: str = "source", analyzer: str = "english") -> tuple[int, int, int]:
    """Put the documents' sources into the index at ``path``, in place of what it holds of these sources: (commit, postings out, in)."""
    parts, split = index_parts(docs, text, source)
    packed = _packed(docs, id_col, text, source, analyzer).repartition(parts, "source", "bucket", F.pmod(F.xxhash64("lexeme"), F.lit(split)))
    return versioned.replace(_postings(packed).sortWithinPartitions("source", "bucket", "lexeme", "id"), path, "source", ["bucket"])


def statistics(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """One row (n, mean): documents of the index and their mean length, from the marks' bucket alone."""
    marks = versioned.read(spark, path).where(F.col("bucket") == bucket(F.lit("")))
    marks = marks.where(F.col("lexeme") == "")
    marks = marks.where(F.col("source").isin(sources)) if sources is not None else marks
    return marks.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))


def _terms(spark: SparkSession, query: str, analyzer: str) -> list[str]:
    """Distinct lexemes of one query, a short text."""
    words = spark.createDataFrame([(query,)], "q string").select(F.explode(_words("q", analyzer)).alias("word"))
    return sorted({r.lexeme for r in _stemmed(words, analyzer).collect()})


def matches(spark: SparkSession, path: str, query: str, sources: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(source, id, at, lexeme) of all places of the query's lexemes in documents that hold every one of them; and the lexemes.

    A query of stop words only matches nothing.
    """
    terms = _terms(spark, query, "english")
    buckets = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket("t")).collect()})
    found = versioned.read(spark, path).where(F.col("bucket").isin(buckets) & F.col("lexeme").isin(terms))
    found = found.where(F.col("source").isin(sources)) if sources is not None else found
    whole = found.groupBy("source", "id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("held")).where(F.size(F.array_distinct(F.col("held.lexeme"))) == len(terms))
    places = whole.select("source", "id", F.explode("held").alias("h")).select("source", "id", F.explode("h.positions").alias("at"), F.col("h.lexeme").alias("lexeme"))
    return places, terms


def covers(places: DataFrame, terms: list[str]) -> DataFrame:
    """(source, id, first, last, n) of the minimal covers: shortest spans of a document that hold all ``terms``; ``n`` places in each.

    Swept from left to right: up to each place, the last place of every term is known, and the least of these starts the
    shortest span that ends here. It is minimal if no earlier place ends a span with the same start.
    """
    row = W.Window.partitionBy("source", "id").orderBy("at")
    numbered = places.withColumn("r", F.row_number().over(row))
    last = [F.last(F.when(F.col("lexeme") == t, F.struct("at", "r")), ignorenulls=True).over(row) for t in terms]
    known = [x.isNotNull() for x in last]
    start = F.least(*last) if len(last) > 1 else last[0]
    complete = known[0]
    for k in known[1:]:
        complete = complete & k
    spans = numbered.withColumn("start", F.when(complete, start))
    spans = spans.withColumn("before", F.lag("start").over(row)).where("start is not null and (before is null or start.at > before.at)")
    return spans.select("source", "id", F.col("start.at").alias("first"), F.col("at").alias("last"), (F.col("r") - F.col("start.r") + 1).alias("n"))


def keyword_topk(spark: SparkSession, path: str, query: str, k: int, sources: list[str] | None = None) -> DataFrame:
    """(id, score) of the k documents that hold every lexeme of the query, by cover density.

    Each minimal cover adds its weight divided by 1 plus the words in it that aren't of the query, so terms that stand close
    together, and often, rank high. Ties go to the smaller id.
    """
    places, terms = matches(spark, path, query, sources)
    if not terms:
        return places.select("id", F.lit(0.0).alias("score")).limit(0)
    noise = F.col("last") - F.col("first") - (F.col("n") - 1)
    noise = F.when(noise < 0, F.floor((F.col("n") - 1) / 2)).otherwise(noise)
    scored = covers(places, terms).groupBy("id").agg(F.sum(F.lit(WEIGHT) / (1 + noise)).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def bm25(spark: SparkSession, path: str, queries: DataFrame, k1: float = 1.5, b: float = 0.75, sources: list[str] | None = None) -> DataFrame:
    """(query_id, id, score): BM25 of every query (query_id, query) over a ``plain`` index; query terms count with multiplicity.

    The queries' terms are joined with the postings on bucket and lexeme, so only their buckets are read.
    """
    asked = queries.select("query_id", F.explode(_words("query", "plain")).alias("lexeme")).groupBy("query_id", "lexeme").agg(F.count(F.lit(1)).alias("times"))
    asked = materialize(asked.withColumn("bucket", bucket("lexeme")))
    wanted = broadcast_if_small(asked.select("bucket", "lexeme").distinct())
    all_ = versioned.read(spark, path)
    all_ = all_.where(F.col("source").isin(sources)) if sources is not None else all_
    found = materialize(all_.join(wanted, ["bucket", "lexeme"]).select("lexeme", "id", "tf", "len"))
    df = found.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))
    n, mean = statistics(spark, path, sources).first()
    idf = F.ln(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.lit(mean)))
    weighted = asked.select("query_id", "lexeme", "times").join(df, "lexeme")
    # by documents first: a posting is shorter than its scores for all queries, which then stay in the task
    found = found.repartition(max(shuffle_parts(spark), -(-found.count() // FOUND)), "id")
    return found.join(broadcast_if_small(weighted), "lexeme").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(lexeme, documents, places) of a whole ``plain`` index."""
    return versioned.read(spark, path).where("lexeme <> ''").groupBy("lexeme").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("places"))
