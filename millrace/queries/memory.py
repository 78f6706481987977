"""Memory lifecycle, entity resolution, web and event-stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scoring as SC
from millrace.operators import memory as M
from millrace.operators import resolution as R
from millrace.operators import web as H
from millrace.sources.tables import table
from millrace.streaming import events as ST


def _now(text: str = "2024-02-01"):
    return F.to_timestamp_ntz(F.lit(text)).cast("timestamp")


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _memories(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["core", "semantic", "preference", "procedural", "fact", "episodic"])), (F.col("event_id") % 6 + 1).cast("int"))
    return _events(spark, sf).select(F.col("event_id").alias("memory_id"), "user_id", kind.alias("kind"), (F.col("event_id") % 12).cast("int").alias("access_count"), (F.col("event_id") % 7).cast("int").alias("related"), F.col("ts").alias("last_accessed_at"), (F.col("ts") - F.expr("interval 40 days")).alias("created_at"), F.lit(1).alias("version"), F.col("props").alias("content"))


def retention_sweep(spark, sf):
    return M.sweep(_memories(spark, sf), _now(), 0.2, 50.0).select("memory_id", F.round("retention_score", 6).alias("retention_score"), "expired")


def retention_by_type(spark, sf):
    m = _memories(spark, sf)
    return m.select("memory_id", F.round(SC.retention_by_type("kind", "access_count", "last_accessed_at", "created_at", "related", _now()), 6).alias("score"))


def importance_scores(spark, sf):
    idle = (F.unix_micros(_now()) - F.unix_micros("last_accessed_at")) / 86_400_000_000.0
    return _memories(spark, sf).select("memory_id", F.round(SC.importance("kind", "access_count", "related", idle + 40, idle), 6).alias("importance"))


def due_threads(spark, sf):
    e = _events(spark, sf)
    threads = e.groupBy("user_id").agg((F.max("event_id") % 3 != 0).alias("active"))
    return M.due_threads(threads, e.where("event_type = 'view'").withColumnRenamed("ts", "created_at"), "user_id", _now("2024-01-29"), 48)


def merged_memories(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("r", (F.col("vec_id") % 13).cast("double"))
    return M.merge_near(e, "label", "vec_id", "embedding", "r", 0.75).withColumn("distance", F.round("distance", 6))


def topic_clusters(spark, sf):
    return M.topic_clusters(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.72)


def fact_conflicts(spark, sf):
    f = _events(spark, sf).select("event_id", "user_id", F.col("event_type").alias("key"), (F.col("event_id") % 3).alias("value"), F.col("value").alias("confidence"))
    return M.fact_conflicts(f, ["user_id", "key"], "event_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def audit_outcomes(spark, sf):
    d = _events(spark, sf).select(F.col("event_id").alias("seq"), (F.col("event_id") * 3).alias("memory_id"), F.lit("delete").alias("decision"), (F.col("event_id") % 2).cast("int").alias("expected_version"), F.concat(F.col("user_id"), F.lit("-"), F.col("event_id") % 100).alias("idempotency_key"))
    return M.audit(_memories(spark, sf), d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def context_window(spark, sf):
    m = _events(spark, sf).select("user_id", F.col("event_id").alias("id"), F.repeat("event_type", 4).alias("content"), F.col("value").alias("rank_score"))
    return M.context_window(m.where("id % 2 = 0"), m.where("id % 2 = 1"), "user_id", 200)


def routine_decisions(spark, sf):
    i = _events(spark, sf).select("user_id", "event_id", (F.col("value") / 100).alias("score"), F.col("event_type").alias("verdict"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "healed").otherwise("ok").alias("exec_status"))
    return M.decide(i, "user_id", "event_id", 0.985, 12)


def resolved_entities(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.substring(F.md5((F.col("p_partkey") % 700).cast("string")), 1, 9), F.when(F.col("p_partkey") % 2 == 0, ", Inc.").otherwise("")).alias("name"), F.col("p_brand").alias("kind"), F.col("p_retailprice").alias("confidence"))
    return R.resolve(p)


def vector_resolved(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 3).cast("string").alias("kind"))
    new = e.where("vec_id % 4 = 0").select(F.concat(F.lit("n"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"), F.substring(F.md5((F.col("vec_id") % 40).cast("string")), 1, 12).alias("name"), "kind", F.col("vec_id").alias("confidence"), F.col("embedding").alias("vector"))
    old = e.where("vec_id % 4 = 1").select(F.concat(F.lit("x"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"), F.concat(F.lit("old "), F.col("vec_id")).alias("name"), "kind", F.col("embedding").alias("vector"))
    return R.resolve_with_vectors(new, old, 0.3)


def page_metadata(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[v.alias(k) for k, v in H.metadata("html").items()])


def page_texts(spark, sf):
    return H.page_texts(table(spark, sf, "pages"), ["page_id"]).select("page_id", F.length("text").alias("text_chars"), F.length("markdown").alias("markdown_chars"), F.md5("text").alias("text_digest"), F.md5("markdown").alias("markdown_digest"))


def page_link_counts(spark, sf):
    return H.link_counts(H.page_links(table(spark, sf, "pages"), ["page_id"]), "page_id")


def page_tables(spark, sf):
    return H.page_tables(table(spark, sf, "pages"), ["page_id"]).select("page_id", "table_index", F.size("header").alias("columns"), F.size("rows").alias("n_rows"))


def page_images(spark, sf):
    return H.page_images(table(spark, sf, "pages"), ["page_id"])


def page_code(spark, sf):
    return H.page_code(table(spark, sf, "pages"), ["page_id"])


def typed_events(spark, sf):
    return ST.typed(_events(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def folded_state(spark, sf):
    d = _events(spark, sf).select("user_id", "event_id", F.concat(F.when(F.col("event_id") % 4 == 0, "user:").when(F.col("event_id") % 4 == 1, "app:").when(F.col("event_id") % 4 == 2, "temp:").otherwise(""), F.col("event_type")).alias("key"), F.col("value").cast("string").alias("value"))
    return ST.fold_state(d, "user_id", "event_id", "key", "value").select("user_id", "key", "version", "scope")


def session_windows(spark, sf):
    return ST.sessions(_events(spark, sf), gap="6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def hourly_counts(spark, sf):
    out = ST.windowed_counts(_events(spark, sf), "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_counts(spark, sf):
    return ST.windowed_counts(_events(spark, sf), "2 days", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def deduplicated_events(spark, sf):
    return ST.deduplicated(_events(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"])


def rate_limited_calls(spark, sf):
    return ST.rate_limited(_events(spark, sf), ["user_id"], "ts", 2, 36000).groupBy("allowed").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

_D = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0::DOUBLE"
_KIND = "['core', 'semantic', 'preference', 'procedural', 'fact', 'episodic']"
SQL = {
    "retention_sweep": f"WITH r AS (SELECT event_id AS memory_id, least(1.0::DOUBLE, exp(-0.1::DOUBLE * greatest(0, {_D})) * (1 + ln(1.0::DOUBLE + event_id % 12)) / 5) AS s, {_D} + 40 > 50 AS old FROM events) SELECT memory_id, round(s, 6) AS retention_score, s < 0.2 AND old AS expired FROM r",
    "retention_by_type": f"WITH r AS (SELECT event_id, greatest(0, {_D}) AS d, [0.0, 0.005, 0.05, 0.06, 0.08, 0.1]::DOUBLE[] AS dec, [1.5, 1.4, 1.3, 1.2, 1.15, 1.0]::DOUBLE[] AS mul FROM events) SELECT event_id AS memory_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, exp(-dec[event_id % 6 + 1] * d) * (1 + ln(1.0::DOUBLE + event_id % 12)) * mul[event_id % 6 + 1] * (1 + least(0.5::DOUBLE, (event_id % 7) * 0.1::DOUBLE)) / 5 + greatest(0, 1 - (d + 40) / 365) * 0.1::DOUBLE)), 6) AS score FROM r",
    "importance_scores": f"WITH r AS (SELECT event_id, event_id % 12 AS n, {_D} AS d, [1.0, 0.95, 0.9, 0.75, 0.6, 0.4]::DOUBLE[] AS w FROM events) SELECT event_id AS memory_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN n > 0 THEN least(1.0::DOUBLE, ln(1.0::DOUBLE + n) / ln(1 + sqrt(greatest(1, d + 1)))) ELSE 0.1::DOUBLE END * 0.3::DOUBLE + least(1.0::DOUBLE, ln(1.0::DOUBLE + n) / ln(101.0::DOUBLE)) * 0.25::DOUBLE + least(1.0::DOUBLE, (event_id % 7) / 10) * 0.2::DOUBLE + w[event_id % 6 + 1] * 0.15::DOUBLE + greatest(0, 1 - (d + 40) / 90) * 0.1::DOUBLE)), 6) AS importance FROM r",
    "routine_decisions": """WITH e AS (SELECT user_id, event_id, value / 100 AS score, event_type AS verdict FROM events), k AS (SELECT user_id, verdict <> 'error' AS ok, sum((verdict <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS s FROM e WHERE verdict <> 'signup'),
        f AS (SELECT user_id, count(*) FILTER (s = 0) AS streak FROM k GROUP BY user_id), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM e WHERE score IS NOT NULL),
        n AS (SELECT user_id, coalesce(count(*) > 3 AND max(score) FILTER (r <= 3) <= max(score) FILTER (r > 3), false) AS stalled FROM r GROUP BY user_id), g AS (SELECT *, coalesce((verdict <> lag(verdict) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 0) AS flip FROM r WHERE r <= 4),
        o AS (SELECT user_id, count(*) = 4 AND arg_max(score, event_id) <= arg_min(score, event_id) AND count(verdict) >= 3 AND sum(flip) >= 2 AS swings FROM g GROUP BY user_id), t AS (SELECT user_id, max(coalesce(score >= 0.985::DOUBLE, false)::INT) AS hit, count(*) AS n FROM e GROUP BY user_id)
        SELECT t.user_id, CASE WHEN hit = 1 THEN 'success' WHEN coalesce(streak, 0) >= 3 THEN 'unrecoverable' WHEN n >= 12 THEN 'budget' WHEN stalled THEN 'no_progress' WHEN swings THEN 'oscillation' ELSE 'continue' END AS decision
        FROM t LEFT JOIN f USING (user_id) LEFT JOIN n USING (user_id) LEFT JOIN o USING (user_id)""",
    "resolved_entities": """WITH p AS (SELECT p_partkey AS id, p_brand AS kind, p_retailprice AS c, md5(CAST(p_partkey % 700 AS VARCHAR))[1:9] AS n FROM part), g AS (SELECT *, first_value(id) OVER (PARTITION BY kind, n ORDER BY c DESC, id) AS new FROM p) SELECT id AS old, new FROM g WHERE id <> new""",
    "vector_resolved": """WITH n AS (SELECT 'n' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, md5(CAST(vec_id % 40 AS VARCHAR))[1:12] AS name, label % 3 AS kind, vec_id AS c, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 = 0),
        x AS (SELECT 'x' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, 'old ' || vec_id AS name, label % 3 AS kind, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 = 1),
        g AS (SELECT *, first_value(id) OVER (PARTITION BY kind, name ORDER BY c DESC, id) AS head FROM n), p AS (SELECT g.id, arg_max(x.id, (round(list_cosine_similarity(g.v, x.v), 12), x.id)) AS cid, max(list_cosine_similarity(g.v, x.v)) AS s FROM g JOIN x ON g.kind = x.kind WHERE g.id = head GROUP BY g.id),
        m AS (SELECT g.id AS old, CASE WHEN s >= 0.3 THEN cid WHEN g.id <> head THEN head END AS new, g.name AS old_label, CASE WHEN g.id = head THEN 'vector' ELSE 'name' END AS stage FROM g LEFT JOIN p ON p.id = head)
        SELECT old, new, old_label, coalesce(x.name, n.name) AS new_label, stage FROM m LEFT JOIN x ON x.id = new LEFT JOIN n ON n.id = new WHERE new IS NOT NULL""",
    "due_threads": "WITH t AS (SELECT user_id, max(event_id) % 3 <> 0 AS active FROM events GROUP BY user_id) SELECT user_id, active FROM t WHERE active AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-27')",
    "merged_memories": "WITH p AS (SELECT x.vec_id AS a, y.vec_id AS b, 1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id), m AS (SELECT CASE WHEN a % 13 >= b % 13 THEN b ELSE a END AS loser, CASE WHEN a % 13 >= b % 13 THEN a ELSE b END AS winner, d FROM p WHERE d <= 0.75) SELECT loser, arg_min(winner, (d, winner)) AS winner, round(min(d), 6) AS distance FROM m GROUP BY loser",
    "topic_clusters": "WITH RECURSIVE p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id AND 1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) <= 0.72), w(id, r) AS (SELECT DISTINCT a, a FROM p UNION SELECT w.id, b FROM w JOIN p ON a = r) SELECT id, min(r) AS cluster FROM w GROUP BY id",
    "fact_conflicts": "WITH f AS (SELECT event_id % 3 AS v, value AS c, lag(event_id % 3) OVER w AS ov, lag(value) OVER w AS oc FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)) SELECT CASE WHEN ov IS NULL THEN 'new' WHEN ov = v THEN CASE WHEN c > oc THEN 'refined' ELSE 'same' END WHEN c >= oc THEN 'superseded' ELSE 'contradicted' END AS status, count(*) AS n FROM f GROUP BY 1",
    "audit_outcomes": "WITH d AS (SELECT event_id AS seq, event_id * 3 AS memory_id, event_id % 2 AS v, row_number() OVER (PARTITION BY user_id, event_id % 100 ORDER BY event_id) AS n FROM events) SELECT CASE WHEN n > 1 THEN 'replayed' WHEN m.event_id IS NULL THEN 'missing' WHEN v <> 1 THEN 'conflict' ELSE 'applied' END AS outcome, count(*) AS n FROM d LEFT JOIN events m ON m.event_id = memory_id GROUP BY 1",
    "context_window": "WITH m AS (SELECT user_id, event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'memory' ELSE 'history' END AS part, CAST(length(event_type) * 4 // 4 AS BIGINT) AS tokens, value FROM events), u AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id, part ORDER BY value DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM m) SELECT user_id, part, id, tokens, CAST(used AS BIGINT) AS used FROM u WHERE u.used <= CASE part WHEN 'memory' THEN 60 ELSE 100 END",
    "page_link_counts": """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '<script.*?</script>', '', 'g'), '<a href="([^"]*)">[^<]+</a>', 1)) AS h FROM pages), a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CASE WHEN h LIKE 'http%' THEN regexp_extract(h, '^[a-z]+://([^/]+)', 1) ELSE regexp_extract(url, '^[a-z]+://([^/]+)', 1) END AS d FROM l)
        SELECT page_id, count(*) AS links, count(*) FILTER (host = d) AS internal, count(DISTINCT d) AS domains FROM a GROUP BY page_id""",
    "typed_events": "SELECT CASE event_type WHEN 'error' THEN 'RUN_ERROR' WHEN 'signup' THEN 'RUN_STARTED' WHEN 'purchase' THEN 'STATE_DELTA' ELSE 'MESSAGE' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "folded_state": "WITH d AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'app' ELSE 'session' END AS scope, CASE event_id % 4 WHEN 0 THEN 'user:' WHEN 1 THEN 'app:' ELSE '' END || event_type AS key FROM events WHERE event_id % 4 <> 2) SELECT user_id, key, max(event_id) AS version, scope FROM d GROUP BY user_id, key, scope",
    "session_windows": "WITH l AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL 6 HOURS)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id",
    "hourly_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_counts": "SELECT CAST(s AS TIMESTAMP) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1, 2",
    "deduplicated_events": "SELECT DISTINCT user_id, event_type FROM events",
    "rate_limited_calls": "WITH c AS (SELECT count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND 1 PRECEDING) AS c FROM events) SELECT c < 2 AS allowed, count(*) AS n FROM c GROUP BY 1",
    "page_metadata": r"""WITH h AS (SELECT page_id, html[1:50000] AS h FROM pages), t AS (SELECT page_id, nullif(regexp_extract(h, '(?is)<meta[^>]+property=[\"'']og:title[\"''][^>]+content=[\"'']([^\"'']*)', 1), '') AS og, nullif(trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS t, nullif(regexp_extract(h, '(?is)<meta[^>]+property=[\"'']og:description[\"''][^>]+content=[\"'']([^\"'']*)', 1), '') AS description, nullif(regexp_extract(h, '(?is)<meta[^>]+property=[\"'']og:image[\"''][^>]+content=[\"'']([^\"'']*)', 1), '') AS image FROM h)
        SELECT page_id, coalesce(og, regexp_replace(t, '\s+[|\-–—]\s+[^|\-–—]+$', '')) AS title, description, image FROM t""",
}
