"""Stored indexes and versioned tables: written to the shared folder, replaced by source, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import vector_index as VI
from millrace.plans.materialize import shared_path
from millrace.sources import versioned
from millrace.sources.tables import append_in_batches, table
from millrace.streaming.events import fold_versions, to_table
from millrace.streaming.source import append_batches, read_event_table

#: Vector indexes of this process by application and tables.
_INDEXES: dict[tuple[str, str], str] = {}


def _vectors(spark, sf) -> str:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        path = shared_path(spark, "vectors")
        VI.write_index(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), path, 64, source=F.concat(F.lit("s"), (F.col("id") % 4).cast("string")))
        _INDEXES[key] = path
    return _INDEXES[key]


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def indexed_vectors(spark, sf):
    return VI.search(spark, _vectors(spark, sf), _asked(spark, sf), 5, exact=True).withColumn("score", F.round("score", 6))


def indexed_vectors_filtered(spark, sf):
    found = VI.search(spark, _vectors(spark, sf), _asked(spark, sf), 5, where=(F.col("label") == 3) & (F.col("id") % 2 == 1), exact=True, sources=["s1", "s3"])
    return found.where(F.col("score") >= 0.05).withColumn("score", F.round("score", 6))


def vector_cells_read(spark, sf):
    return VI.share_read(spark, _vectors(spark, sf), _asked(spark, sf), 5, where=F.col("label") == 3).withColumn("share", F.round("share", 6))


def _documents_by_source(spark, sf) -> str:
    """Documents written by source, then one source replaced by its long documents, two deleted, one of them come back."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.coalesce("source", F.lit("-")).alias("src"))
    path = shared_path(spark, "documents")
    versioned.replace(docs, path, "src")
    versioned.replace(docs.where("src = 'src1' and n_chars > 500").withColumn("n_chars", -F.col("n_chars")), path, "src")
    versioned.delete(spark, path, ["src2", "src3", "unknown"])
    versioned.replace(docs.where("src = 'src3' and n_chars % 2 = 0"), path, "src")
    return path


def replaced_sources(spark, sf):
    return versioned.read(spark, _documents_by_source(spark, sf)).select("doc_id", "source", "lang", "n_chars")


def table_history(spark, sf):
    path = _documents_by_source(spark, sf)
    out = None
    for number in versioned.versions(spark, path):
        now = versioned.manifest(spark, path, number).select(F.lit(number).alias("commit"), "source", "rows")
        out = now if out is None else out.union(now)
    return out


def settled_changes(spark, sf):
    expected = F.when(F.col("event_id") % 11 > 0, F.col("event_id") % 6)
    changes = table(spark, sf, "events").select(F.col("user_id").alias("thread"), F.col("event_type").alias("key"), F.col("event_id").alias("change"), expected.alias("expected"), F.col("value").cast("string").alias("value"))
    return fold_versions(changes.where("not (thread % 5 = 0 and expected = 2)")).select("thread", "key", "change", "expected", "status", "version")


def streamed_events(spark, sf):
    rows = append_in_batches(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id", 4000)
    rows = rows.select(F.col("row_no").cast("long").alias("sequence_num"), "event_id", "event_type", "value", "batch")
    path, out = shared_path(spark, "events"), shared_path(spark, "streamed")
    append_batches(rows, path, "batch")
    stream = read_event_table(spark, path if ":" in path else f"file://{path}", rows.drop("batch").schema)
    to_table(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("sequence_num", "event_id", "event_type", "value")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

_NEAR = "SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"
_WRITTEN = "d AS (SELECT doc_id, coalesce(source, '-') AS source, lang, n_chars FROM documents)"
SQL = {
    "settled_changes": """WITH c AS (SELECT user_id AS thread, event_type AS key, event_id AS change, event_id % 6 AS expected FROM events WHERE event_id % 11 > 0 AND NOT (user_id % 5 = 0 AND event_id % 6 = 2)),
        f AS (SELECT *, row_number() OVER (PARTITION BY thread, key, expected ORDER BY change) AS n FROM c), g AS (SELECT thread, key, (SELECT min(v) FROM range(0, 7) r(v) WHERE NOT list_contains(list(expected), v)) AS stop FROM c GROUP BY thread, key)
        SELECT thread, key, change, expected, CASE WHEN n = 1 AND expected < stop THEN 'applied' ELSE 'conflict' END AS status, CASE WHEN n = 1 AND expected < stop THEN expected + 1 ELSE stop END AS version FROM f JOIN g USING (thread, key)""",
    "streamed_events": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS sequence_num, event_id, event_type, value FROM events",
    "indexed_vectors": f"WITH s AS ({_NEAR}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5",
    "indexed_vectors_filtered": f"WITH s AS ({_NEAR} AND e.label = 3 AND e.vec_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND score >= 0.05",
    "replaced_sources": f"WITH {_WRITTEN} SELECT doc_id, source, lang, CASE WHEN source = 'src1' THEN -n_chars ELSE n_chars END AS n_chars FROM d WHERE source NOT IN ('src1', 'src2', 'src3') OR (source = 'src1' AND n_chars > 500) OR (source = 'src3' AND n_chars % 2 = 0)",
    "table_history": f"""WITH {_WRITTEN}, n AS (SELECT source, count(*) AS rows, count(*) FILTER (WHERE n_chars > 500) AS long, count(*) FILTER (WHERE n_chars % 2 = 0) AS even FROM d GROUP BY source),
        c AS (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS "commit"), h AS (SELECT "commit", source, CASE WHEN source = 'src1' AND "commit" > 1 AND long > 0 THEN long WHEN source = 'src2' AND "commit" > 2 THEN 0 WHEN source = 'src3' AND "commit" = 3 THEN 0 WHEN source = 'src3' AND "commit" = 4 THEN even ELSE rows END AS rows FROM n, c)
        SELECT "commit", source, rows FROM h WHERE rows > 0""",
}
