"""Queries of scheduled work, audits, reflections, canonical links and typed entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import extraction as X
from millrace.operators import graph as G
from millrace.operators import memory as M
from millrace.operators import resolution as R
from millrace.sources.tables import table


def _at(text: str):
    return F.to_timestamp_ntz(F.lit(text)).cast("timestamp")


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def reflection_dedup(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", (F.col("event_id") % 5).alias("digest"), "ts", "event_type")
    out = M.new_reflections(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "digest", "ts", 2, 3)
    return out.select("event_id", "user_id", "digest")


def stale_runs(spark, sf):
    runs = _events(spark, sf).select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("started_at"))
    return M.stale_runs(runs, _at("2024-02-01"), 21_600).select("event_id", "status")


def next_fire_times(spark, sf):
    e = _events(spark, sf)
    kind = F.when(F.col("event_id") % 3 == 0, "interval").otherwise("once")
    tasks = e.select("event_id", kind.alias("kind"), F.when((F.col("event_id") % 3 == 0) | (F.col("event_id") % 2 == 0), F.col("ts")).alias("last_fire"), (F.col("event_id") % 100 + 1).alias("interval_seconds"), (F.col("ts") + F.expr("interval 1 day")).alias("start_at"))
    return M.next_fire(tasks).select("event_id", F.col("next_fire").cast("timestamp_ntz").alias("next_fire"))


def core_blocks(spark, sf):
    blocks = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"), F.col("text").alias("content"))
    return M.core_block(blocks, ["doc_id"], 300).select("doc_id", "version", F.md5("content").alias("digest"))


def applied_audits(spark, sf):
    e = _events(spark, sf)
    memories = e.select(F.col("event_id").alias("memory_id"), F.lit(1).alias("version"), F.col("event_type").alias("content"))
    choice = F.when(F.col("event_id") % 3 == 0, "delete").when(F.col("event_id") % 3 == 1, "anonymize").otherwise("retain")
    decisions = e.select(F.col("event_id").alias("seq"), (F.col("event_id") * 3).alias("memory_id"), choice.alias("decision"), F.lit(1).alias("expected_version"), F.col("event_id").cast("string").alias("idempotency_key"))
    return M.apply_audit(memories, M.audit(memories, decisions)).select("memory_id", "content")


def canonical_links(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("vector"))
    name = F.when(F.col("id") % 20 == 1, F.concat(F.lit("Item "), F.col("id") - 1)).otherwise(F.concat(F.lit("other "), F.col("id")))
    return R.link_canonical(v.where("id % 20 <> 0").withColumn("name", name), v.where("id % 20 = 0").withColumn("name", F.concat(F.lit("item "), F.col("id"))), 0.5, 0.35)


def typed_entities(spark, sf):
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey"))
    found = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.lit("other").alias("kind"), F.lit(0.5).alias("confidence"))
    known = found.where("id % 10 = 0").select(F.upper("name").alias("name"), F.lit("part").alias("known_kind"))
    return X.typed_entities(found, known, "7$").select("id", "kind")


def expired_relations(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("valid_to"))
    return G.expire(o, o.where("id % 7 = 0").select("id"), "id", _at("1998-01-01")).select("id", F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


def near_memory_pairs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    cosine = F.when(F.col("doc_id") % 5 == 0, 0.9).otherwise(0.81)
    return pairs.select("doc_id", X.near_words(F.col("text"), F.col("next"), cosine).alias("near"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'))"
SQL = {
    "reflection_dedup": """WITH e AS (SELECT event_id, user_id, event_id % 5 AS digest, ts, CAST(ts AS DATE) AS day, event_type FROM events), c AS (SELECT * FROM e WHERE event_type = 'click'), o AS (SELECT * FROM e WHERE event_type = 'view'),
        f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = c.user_id AND o.digest = c.digest AND o.ts < c.ts AND o.ts >= c.ts - INTERVAL 3 DAY)), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, digest, day ORDER BY ts) = 1)
        SELECT event_id, user_id, digest FROM g QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, digest) <= 2""",
    "stale_runs": "SELECT event_id, CASE WHEN event_type <> 'view' THEN 'done' WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) > 1296000000000 THEN 'timed_out' ELSE 'running' END AS status FROM events",
    "next_fire_times": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts + to_seconds(event_id % 100 + 1) WHEN event_id % 2 <> 0 THEN ts + INTERVAL 1 DAY END AS next_fire FROM events",
    "core_blocks": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS used FROM l)
        SELECT doc_id, 2 AS version, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM u WHERE used <= 300 GROUP BY doc_id""",
    "applied_audits": "SELECT m.event_id AS memory_id, CASE WHEN d.event_id % 3 = 1 THEN '[anonymized]' ELSE m.event_type END AS content FROM events m LEFT JOIN events d ON d.event_id * 3 = m.event_id WHERE d.event_id IS NULL OR d.event_id % 3 <> 0",
    "canonical_links": """WITH e AS (SELECT vec_id AS id, label AS kind, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 20 = 1 THEN 'item ' || (vec_id - 1) ELSE 'other ' || vec_id END AS n FROM embeddings WHERE vec_id % 20 <> 0), c AS (SELECT vec_id AS id, label AS kind, embedding::DOUBLE[] AS v, 'item ' || vec_id AS n FROM embeddings WHERE vec_id % 20 = 0),
        x AS (SELECT e.id, min(c.id) AS cid FROM e JOIN c ON e.n = c.n AND e.kind = c.kind GROUP BY e.id), p AS (SELECT e.id, c.id AS cid, list_cosine_similarity(e.v, c.v) AS s FROM e JOIN c ON e.kind = c.kind WHERE e.id NOT IN (SELECT id FROM x)), b AS (SELECT id, arg_max(cid, (s, cid)) AS cid, max(s) AS s FROM p GROUP BY id)
        SELECT id, cid AS canonical_id, 'exact' AS decision FROM x UNION ALL SELECT e.id, CASE WHEN s >= 0.35 THEN cid END, CASE WHEN s >= 0.5 THEN 'merge' WHEN s >= 0.35 THEN 'review' ELSE 'new' END FROM e LEFT JOIN b ON b.id = e.id WHERE e.id NOT IN (SELECT id FROM x)""",
    "typed_entities": "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'part' WHEN p_partkey % 10 = 7 THEN 'product' ELSE 'other' END AS kind FROM part",
    "expired_relations": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '1998-01-01' ELSE o_orderdate END AS valid_to FROM orders",
    "near_memory_pairs": f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT a.doc_id, a.doc_id % 5 = 0 OR coalesce(len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 0) >= 0.7 AS near FROM w a JOIN w b ON b.doc_id = a.doc_id + 1",
}
