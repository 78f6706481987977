"""Filters, joins, aggregates and ordered logic over the event log and the document store."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.functions import scoring as SC
from millrace.operators import aggregates as A
from millrace.operators import joins as J
from millrace.operators import windows as WN
from millrace.sources import tables as ST
from millrace.sources.tables import table

T0 = "2024-01-15"


def _now(text: str = "2024-02-01"):
    return F.to_timestamp_ntz(F.lit(text)).cast("timestamp")


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _naive(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


# --- filters ------------------------------------------------------------------------------------------------------------------


def metadata_predicates(spark, sf):
    meta = F.when(F.col("doc_id") % 5 == 0, '{"archived": true}').when(F.col("doc_id") % 5 == 1, '{"searchable": false}').when(F.col("doc_id") % 5 == 2, '{"deleted": "true"}').when(F.col("doc_id") % 5 == 3, "not json")
    d = _docs(spark, sf).select("doc_id", meta.alias("m"))
    return d.select("doc_id", P.active("m").alias("active"), P.searchable("m").alias("searchable"), P.not_deleted("m").alias("not_deleted"))


def json_containment(spark, sf):
    props = F.concat(F.lit('{"user": {"role": "'), F.when(F.col("event_id") % 3 == 0, "admin").otherwise("reader"), F.lit('"}, "tags": ["'), F.col("event_type"), F.lit('", "x"], "k": '), (F.col("event_id") % 4).cast("string"), F.lit("}"))
    e = _events(spark, sf).withColumn("doc", props)
    return e.where(P.json_contains("doc", {"user": {"role": "admin"}, "tags": ["click"], "k": 2})).select("event_id", "event_type")


def json_property(spark, sf):
    return _events(spark, sf).select("event_id", P.json_value("props", "$.k", "int").alias("k")).where("k > 50")


def text_contains(spark, sf):
    return _docs(spark, sf).where(P.contains_text("text", "THE%")).select("doc_id")


def ilike_fallback(spark, sf):
    found = _docs(spark, sf).where(P.contains_text("text", "tion") & F.col("lang").isin("en", "fr"))
    return found.orderBy(F.desc("doc_id")).offset(5).limit(20).select("doc_id", "lang", "n_chars")


def time_slice(spark, sf):
    e = _events(spark, sf).where(F.col("ts").between(_now("2024-01-10"), _now("2024-01-12")))
    return _naive(e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "user_id"), "ts")


def valid_as_of(spark, sf):
    edges = _edges(spark, sf)
    return edges.where(P.valid_at("valid_from", "valid_to", _now("1996-01-01"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _edges(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("c"), F.col("o_custkey")).alias("source"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.col("o_orderpriority").alias("type"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"), F.col("l_shipdate").cast("timestamp").alias("valid_to"), F.col("l_quantity").alias("weight"))
    return o.join(li, "k").select("source", "target", "type", "weight", "valid_from", "valid_to")


def tuple_in(spark, sf):
    pairs = spark.createDataFrame([("en", "src1"), ("de", "src2"), ("fr", "src3")], "lang string, source string")
    return _docs(spark, sf).join(F.broadcast(pairs), ["lang", "source"], "left_semi").select("doc_id", "lang", "source")  # a stated list


def access_decisions(spark, sf):
    e = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 4 == 0, F.array(F.lit("*"))).when(F.col("event_id") % 4 == 1, F.array(F.lit("editor"))).alias("roles"), F.when(F.col("event_id") % 4 == 2, F.array(F.col("user_id").cast("string"))).alias("users"))
    return e.select("event_id", P.allowed("roles", "users", "editor", "3").alias("allowed"))


def natural_language(spark, sf):
    return _events(spark, sf).withColumn("c", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": 1, "b": '), F.col("event_id"), F.lit("}"))).otherwise(F.col("props"))).groupBy(P.natural_language("c").alias("natural")).agg(F.count(F.lit(1)).alias("n"))


# --- joins --------------------------------------------------------------------------------------------------------------------


def temporal_links(spark, sf):
    return J.temporal_links(_events(spark, sf), "user_id", "event_id", "ts", 30.0, 10).withColumn("weight", F.round("weight", 6))


def shared_user_links(spark, sf):
    return J.shared_key_links(_events(spark, sf).where("event_type = 'purchase'"), "user_id", "event_id", "ts", 5)


def incident_counts(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    return J.incident_counts(s, _edges(spark, sf)).select("id", "degree")


def both_ends_kept(spark, sf):
    edges = _edges(spark, sf).select("source", "target").distinct()
    kept = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().where(F.substring("id", -1, 1).isin("1", "2"))
    return J.with_both_ends(edges, kept)


def labelled_edges(spark, sf):
    v = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name")).union(table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")), "c_name"))
    return J.labelled_edges(_edges(spark, sf).select("source", "target").distinct(), v).groupBy(F.col("source_name").isNull().alias("no_source"), F.col("target_name").isNull().alias("no_target")).agg(F.count(F.lit(1)).alias("n"), F.min("target_name").alias("least"))


def vertices_with_edge(spark, sf):
    v = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"))
    return J.with_valid_edge(v, _edges(spark, sf).where(P.valid_at("valid_from", "valid_to", _now("1996-01-01"))))


def users_without_recent(spark, sf):
    e = _events(spark, sf)
    return J.without_recent(e.select("user_id").distinct(), e.where("event_type = 'purchase'"), "user_id", "ts", _now("2024-01-28"))


def nearest_in_block(spark, sf):
    return J.nearest_under(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.75).withColumn("distance", F.round("distance", 6))


# --- aggregates -----------------------------------------------------------------------------------------------------------------


def source_summary(spark, sf):
    d = _docs(spark, sf).withColumn("uri", F.when(F.col("source") != "src0", F.col("source")))
    return A.source_summary(d, "uri", F.col("doc_id") % 3 != 0, "lang")


def fully_archived_sources(spark, sf):
    return A.fully_archived(_docs(spark, sf), ["source", "lang"], F.col("n_chars") > 500)


def retention_distribution(spark, sf):
    return A.retention_distribution(_events(spark, sf).withColumn("score", F.least(F.lit(1.0), F.col("value") / 100)), "score").withColumn("avg_score", F.round("avg_score", 6))


def memory_metrics(spark, sf):
    out = A.memory_metrics(_events(spark, sf), "value", 20.0)
    return out.select(*[F.round(c, 6).alias(c) if c != "low_count" else F.col(c) for c in out.columns])


def _logs(spark, sf):
    ids = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("event_id") % 50, F.col("user_id")))
    feedback = F.when(F.col("event_type") == "click", "helpful").when(F.col("event_type") == "error", "irrelevant")
    return _events(spark, sf).select("event_id", ids.alias("ids"), feedback.alias("feedback"), (F.col("event_type") == "purchase").alias("referenced"))


def retrieval_effectiveness(spark, sf):
    out = A.retrieval_effectiveness(_logs(spark, sf), "ids", F.col("referenced"), "feedback")
    return out.select("total", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def rocchio_weights(spark, sf):
    return A.rocchio_weights(_logs(spark, sf), "ids", "feedback").withColumn("weight", F.round("weight", 6))


def relation_timeline(spark, sf):
    return _naive(A.timeline(_edges(spark, sf), "valid_from", "valid_to", "week", 100), "bucket")


def cross_references(spark, sf):
    words = _docs(spark, sf).select("source", F.explode(F.slice(F.split("text", " "), 1, 200)).alias("name"))
    return A.cross_references(words, "source", "name", 0.1).withColumn("confidence", F.round("confidence", 6))


def corpus_quality(spark, sf):
    d = _docs(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    out = A.corpus_quality(d, "source", F.col("lang") != "es", (F.col("doc_id") % 400).cast("double"), F.col("label").isNotNull())
    return out.select("source", "documents", *[F.round(c, 6).alias(c) for c in ("diversity", "embedding_coverage", "freshness", "total_score")], "grade")


def next_versions(spark, sf):
    e = _events(spark, sf)
    old = e.where("event_id % 10 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("version"))
    return A.next_versions(old, e.where("event_type = 'signup'").select("user_id", "event_id"), ["user_id"], "event_id").select("user_id", "event_id", F.col("version").cast("long").alias("version"))


def language_facets(spark, sf):
    return A.facets(_docs(spark, sf), "lang")


def top_keys(spark, sf):
    out = A.top_keys(_docs(spark, sf), "source", "lang", 3)
    return out.withColumn("top", F.array_join("top", ","))


def latency_by_type(spark, sf):
    return A.latency_by_tool(_events(spark, sf), "user_id", "value", F.col("event_type") == "error").withColumn("avg_latency", F.round("avg_latency", 6))


def suspicious_reingest(spark, sf):
    return A.suspicious_reingest(_events(spark, sf).where("event_type = 'purchase'"), "user_id", "ts", 15)


def user_totals(spark, sf):
    e = _events(spark, sf)
    return A.user_totals(e.where("event_type = 'signup' and value > 50").select("user_id"), e.select("user_id"), "user_id")


def _runs(spark, sf):
    status = F.when(F.col("event_type").isin("click", "purchase"), "success").when(F.col("event_type") == "error", "failed").otherwise("running")
    return _events(spark, sf).withColumn("status", status)


def task_stats(spark, sf):
    return A.task_stats(_runs(spark, sf), "user_id", "status", "ts", _now("2024-01-05"), _now("2024-01-25")).withColumn("success_rate", F.round("success_rate", 6))


def window_kpis(spark, sf):
    return A.window_kpis(_runs(spark, sf), "status", "value", "ts", _now("2024-01-20")).withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_latency")})


def corpus_chunk_counts(spark, sf):
    corpora = _docs(spark, sf).select("source").distinct().union(spark.createDataFrame([("empty",)], "source string"))
    return A.corpus_chunk_counts(corpora, _docs(spark, sf).withColumn("role", F.when((F.col("lang") == "de") & (F.col("source") != "src1"), "parent").otherwise("child")), "source", "role")


def weekly_decay_rate(spark, sf):
    return A.decay_rate(_events(spark, sf), "ts", "value", _now("2024-01-31")).withColumn("decay_rate", F.round("decay_rate", 6))


def type_distribution(spark, sf):
    out = A.type_distribution(_docs(spark, sf), "source", "lang")
    return out.select("source", "total", "main_type", "conflict", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("types"))


def centroids(spark, sf):
    out = A.centroid(table(spark, sf, "embeddings"), "label", "embedding")
    return out.select("label", F.posexplode("centroid").alias("i", "v")).select("label", "i", F.round("v", 6).alias("v"))


def ir_metrics(spark, sf):
    d = _docs(spark, sf)
    ranked = WN.latest_n(d.withColumn("query_id", F.col("source")), "query_id", "n_chars", "doc_id", 30).select("query_id", F.col("doc_id").alias("id"), (F.lit(31) - F.col("position")).alias("rank"))
    relevant = table(spark, sf, "labels").where("quality = 1").join(d, "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"))
    out = A.ir_metrics(ranked, relevant, 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "recall")], "hit")


def flag_summary(spark, sf):
    out = A.flag_summary(_events(spark, sf), "user_id", "event_type")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("flags"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("flags"))


def type_entropy(spark, sf):
    return A.entropy(_events(spark, sf), "event_type").withColumn("entropy", F.round("entropy", 6))


def pii_rate(spark, sf):
    return A.pii_rate(_docs(spark, sf), F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).withColumn("rate", F.round("rate", 6))


# --- windows ------------------------------------------------------------------------------------------------------------------


def first_event_per_user(spark, sf):
    return _naive(WN.first_per_key(_events(spark, sf), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "ts"), "ts")


def latest_events(spark, sf):
    return WN.latest_n(_events(spark, sf), "user_id", "ts", "event_id", 4).select("user_id", "event_id", "position")


def sessions(spark, sf):
    out = WN.sessions(_events(spark, sf), "user_id", "ts", "event_id", 6 * 3600)
    return out.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def complete_indices(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("i", F.col("l_linenumber") - 1)
    return WN.complete_indices(li, "l_orderkey", "i", F.col("l_returnflag") != "R")


def failure_streaks(spark, sf):
    return WN.failure_streak(_events(spark, sf), "user_id", "event_id", F.col("event_type").isin("error", "view"), F.col("event_type") == "signup")


def no_progress(spark, sf):
    return WN.no_progress(_events(spark, sf), "user_id", "event_id", "value", 5)


def oscillation(spark, sf):
    return WN.oscillating(_events(spark, sf), "user_id", "event_id", "value", "event_type")


def break_groups(spark, sf):
    from pyspark.sql import window as W

    e = table(spark, sf, "embeddings").withColumn("prev", F.lag("label").over(W.Window.partitionBy(F.col("vec_id") % 7).orderBy("vec_id"))).withColumn("k", F.col("vec_id") % 7)
    out = WN.breaks(e, "k", "vec_id", F.abs(F.col("label") - F.col("prev")) <= 3)
    return out.select("vec_id", "k", F.col("group").alias("grp"))


def budget_prefix(spark, sf):
    out = WN.within_budget(_docs(spark, sf), "source", [F.col("doc_id")], "n_chars", 20000)
    return out.select("source", "doc_id", "used")


def density_cap(spark, sf):
    return WN.density_cap(_events(spark, sf), "user_id", F.lit(1000), "value", "event_id").select("user_id", "event_id")


def turn_segments(spark, sf):
    c = table(spark, sf, "conversations")
    out = WN.segments(c, "conv_id", "turn", F.concat_ws(": ", "role", "text"), 5)
    return out.select("conv_id", "segment", "turns", F.md5("content").alias("digest"))


def latest_statuses(spark, sf):
    return WN.latest_values(_events(spark, sf), "user_id", "ts", "event_type", 3).withColumn("latest", F.array_join("latest", ","))


def reindexed_positions(spark, sf):
    return WN.reindex(table(spark, sf, "customer"), "c_nationkey", "c_name", "c_custkey").select("c_custkey", "c_nationkey", "position")


def rate_window(spark, sf):
    return WN.rate_in_window(_events(spark, sf), ["user_id"], "ts", 36000).where("recent_calls > 3").select("event_id", "recent_calls")


def keyset_page(spark, sf):
    return WN.keyset_page(_events(spark, sf), "ts", "event_id", _now(T0), 500, 20).select("event_id", "user_id")


def nulls_last_page(spark, sf):
    d = _docs(spark, sf).withColumn("score", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")))
    return d.orderBy(F.desc_nulls_last("score"), "doc_id").offset(10).limit(15).select("doc_id", "score")


def proactive_recall(spark, sf):
    e = _events(spark, sf)
    idle = (F.unix_micros(_now()) - F.unix_micros("ts")) / 86_400_000_000.0
    return e.withColumn("rank_score", F.round(SC.recall_rank(F.col("value") / 100, idle, F.col("user_id") % 20), 6)).where("value > 20").orderBy(F.desc("rank_score"), "event_id").limit(20).select("event_id", "rank_score")


# --- sources ------------------------------------------------------------------------------------------------------------------


def replace_by_source(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", "source")
    new = d.where("source = 'src1' and lang = 'en'").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return ST.replace_by_source(d, new, ["lang"], "source")


def delete_by_source(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.when(F.col("source") != "src2", F.col("source")).alias("source"))
    return ST.delete_by_source(d, "source", None)


def upsert_latest(spark, sf):
    e = _events(spark, sf).select("user_id", "event_type", "event_id", "value")
    return ST.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def upsert_relations(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("source"), (F.col("event_id") % 10).alias("target"), F.col("event_type").alias("type"), F.col("value").alias("weight"), (F.col("value") / 100).alias("confidence"), F.col("event_id").alias("seq"))
    old = e.where("seq % 3 = 0").groupBy("source", "target", "type").agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("observation_count")).withColumn("is_active", F.lit(False)).withColumn("valid_to", F.lit("2024-01-01"))
    return ST.upsert_relations(old, e.where("seq % 3 = 1"))


def compare_and_set(spark, sf):
    e = _events(spark, sf)
    old = e.where("user_id % 3 <> 0").groupBy("user_id").agg(F.max(F.col("event_id") % 5).alias("version"))
    changes = e.groupBy("user_id").agg(F.max(F.when(F.col("user_id") % 2 == 0, F.lit(4))).cast("long").alias("expected"))
    return ST.compare_and_set(old, changes, "user_id")


def hash_dedup(spark, sf):
    return ST.dedup_by_hash(_docs(spark, sf), "text", ["lang"], "doc_id").select("doc_id", "file_hash")


def claimed_rows(spark, sf):
    return ST.claim(_docs(spark, sf), "doc_id", 4).groupBy("worker").agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark, sf):
    d = _docs(spark, sf)
    a, b = d.where("doc_id % 2 = 0").select("lang", "source"), d.where("doc_id % 3 = 0").select("lang", "source")
    return a.exceptAll(b).withColumn("op", F.lit("except_all")).union(a.intersect(b).withColumn("op", F.lit("intersect"))).union(a.union(b).distinct().withColumn("op", F.lit("union"))).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

_EDGES = "edges AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, o_orderpriority AS type, l_quantity AS weight, o_orderdate AS valid_from, l_shipdate AS valid_to FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_LOGS = "logs AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN [] ELSE [event_id % 50, user_id] END AS ids, CASE event_type WHEN 'click' THEN 'helpful' WHEN 'error' THEN 'irrelevant' END AS feedback, event_type = 'purchase' AS referenced FROM events)"
_RUNS = "runs AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN 'success' WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status FROM events)"

SQL = {
    "metadata_predicates": "SELECT doc_id, doc_id % 5 <> 0 AS active, doc_id % 5 <> 1 AS searchable, doc_id % 5 <> 2 AS not_deleted FROM documents",
    "json_containment": "SELECT event_id, event_type FROM events WHERE event_id % 3 = 0 AND event_type = 'click' AND event_id % 4 = 2",
    "json_property": "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events WHERE CAST(props->>'k' AS INTEGER) > 50",
    "text_contains": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the%')",
    "ilike_fallback": "SELECT doc_id, lang, n_chars FROM documents WHERE text ILIKE '%tion%' AND lang IN ('en', 'fr') ORDER BY doc_id DESC LIMIT 20 OFFSET 5",
    "time_slice": "SELECT event_id, ts, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "valid_as_of": f"WITH {_EDGES} SELECT type, count(*) AS n FROM edges WHERE valid_from <= TIMESTAMP '1996-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-01-01') GROUP BY type",
    "tuple_in": "SELECT doc_id, lang, source FROM documents WHERE (lang, source) IN (('en', 'src1'), ('de', 'src2'), ('fr', 'src3'))",
    "access_decisions": "SELECT event_id, event_id % 4 IN (0, 1, 3) OR user_id = 3 AS allowed FROM events",
    "natural_language": "SELECT event_id % 2 <> 0 AS natural, count(*) AS n FROM events GROUP BY 1",
    "temporal_links": """WITH p AS (SELECT x.event_id AS a, y.event_id AS b, abs(epoch_us(x.ts) - epoch_us(y.ts)) / 60000000.0::DOUBLE AS gap FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id <> y.event_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 1800000000)
        SELECT a, b, round(greatest(0.3::DOUBLE, 1 - gap / 30), 6) AS weight FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY gap, b) <= 10""",
    "shared_user_links": """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase')
        SELECT x.event_id AS a, y.event_id AS b, 0.6::DOUBLE AS weight FROM r x JOIN r y ON x.user_id = y.user_id AND y.r BETWEEN x.r + 1 AND x.r + 5""",
    "incident_counts": f"WITH {_EDGES} SELECT 's' || s_suppkey AS id, (SELECT count(*) FROM edges WHERE source = 's' || s_suppkey OR target = 's' || s_suppkey) AS degree FROM supplier",
    "both_ends_kept": f"WITH {_EDGES} SELECT DISTINCT source, target FROM edges WHERE right(source, 1) IN ('1', '2') AND right(target, 1) IN ('1', '2')",
    "labelled_edges": f"WITH {_EDGES}, e AS (SELECT DISTINCT source, target FROM edges), v AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0) SELECT a.name IS NULL AS no_source, b.name IS NULL AS no_target, count(*) AS n, min(b.name) AS least FROM e LEFT JOIN v a ON a.id = source LEFT JOIN v b ON b.id = target GROUP BY 1, 2",
    "vertices_with_edge": f"WITH {_EDGES} SELECT 'c' || c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM edges WHERE source = 'c' || c_custkey AND valid_from <= TIMESTAMP '1996-01-01' AND valid_to > TIMESTAMP '1996-01-01')",
    "users_without_recent": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-28')",
    "nearest_in_block": "SELECT x.vec_id AS a, y.vec_id AS b, round(1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS distance FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE 1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) <= 0.75",
    "source_summary": "SELECT CASE WHEN source <> 'src0' THEN source END AS uri, count(*) AS chunks, bool_and(doc_id % 3 <> 0) AS archived, min(lang) AS display_name FROM documents GROUP BY 1",
    "fully_archived_sources": "SELECT source, lang FROM documents GROUP BY source, lang HAVING bool_and(n_chars > 500)",
    "retention_distribution": "WITH s AS (SELECT least(1.0::DOUBLE, value / 100) AS score FROM events) SELECT count(*) AS total, round(avg(score), 6) AS avg_score, count(*) FILTER (score >= 0.7) AS high, count(*) FILTER (score >= 0.3 AND score < 0.7) AS medium, count(*) FILTER (score < 0.3) AS low FROM s",
    "memory_metrics": "SELECT round(avg(value), 6) AS avg_score, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, count(*) FILTER (value < 20) AS low_count FROM events",
    "retrieval_effectiveness": f"WITH {_LOGS} SELECT count(*) AS total, round(count(*) FILTER (referenced) / count(*), 6) AS precision, round(count(*) FILTER (feedback = 'helpful') / count(feedback), 6) AS utilization, round(count(*) FILTER (feedback = 'irrelevant') / count(feedback), 6) AS noise, round(count(*) FILTER (len(ids) = 0) / count(*), 6) AS zero_hit FROM logs",
    "rocchio_weights": f"WITH {_LOGS}, v AS (SELECT unnest(ids) AS id, feedback FROM logs WHERE feedback IS NOT NULL), s AS (SELECT id, count(*) FILTER (feedback = 'helpful') AS h, count(*) FILTER (feedback = 'irrelevant') AS i, count(*) AS n FROM v GROUP BY id), w AS (SELECT id, CASE WHEN n < 3 THEN 1.0::DOUBLE ELSE least(2.0::DOUBLE, greatest(0.5::DOUBLE, 1 + 0.75::DOUBLE * h / n - 0.15::DOUBLE * i / n)) END AS weight FROM s) SELECT id, round(weight, 6) AS weight FROM w WHERE abs(weight - 1) >= 1e-6",
    "relation_timeline": f"WITH {_EDGES}, b AS (SELECT date_trunc('week', valid_from) AS bucket, 1 AS s, 0 AS e FROM edges UNION ALL SELECT date_trunc('week', valid_to), 0, 1 FROM edges WHERE valid_to IS NOT NULL) SELECT CAST(bucket AS TIMESTAMP) AS bucket, CAST(sum(s) AS BIGINT) AS started, CAST(sum(e) AS BIGINT) AS ended FROM b GROUP BY b.bucket ORDER BY b.bucket DESC LIMIT 100",
    "cross_references": "WITH w AS (SELECT DISTINCT source AS c, lower(unnest(string_split(text, ' ')[1:200])) AS n FROM documents), s AS (SELECT c, count(*) AS size FROM w GROUP BY c), p AS (SELECT x.c AS a, y.c AS b, count(*) AS shared FROM w x JOIN w y ON x.n = y.n AND x.c < y.c GROUP BY 1, 2) SELECT a, b, shared, round(shared / (sa.size + sb.size - shared), 6) AS confidence FROM p JOIN s sa ON sa.c = a JOIN s sb ON sb.c = b WHERE shared / (sa.size + sb.size - shared) >= 0.1",
    "corpus_quality": """WITH d AS (SELECT source, count(*) AS documents, avg((lang <> 'es')::INT::DOUBLE) AS diversity, avg((doc_id % 400)::DOUBLE) AS age, avg((label IS NOT NULL)::INT::DOUBLE) AS embedding_coverage FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source),
        f AS (SELECT *, CASE WHEN age <= 30 THEN 1.0::DOUBLE WHEN age >= 365 THEN 0.1::DOUBLE ELSE 1 - (age - 30) / 335 * 0.9::DOUBLE END AS freshness FROM d), t AS (SELECT *, 0.15::DOUBLE * (diversity + freshness + embedding_coverage) AS total_score FROM f)
        SELECT source, documents, round(diversity, 6) AS diversity, round(embedding_coverage, 6) AS embedding_coverage, round(freshness, 6) AS freshness, round(total_score, 6) AS total_score, CASE WHEN total_score >= 0.8 THEN 'excellent' WHEN total_score >= 0.6 THEN 'good' WHEN total_score >= 0.4 THEN 'fair' ELSE 'poor' END AS grade FROM t""",
    "next_versions": "WITH o AS (SELECT user_id, count(*) AS v FROM events WHERE event_id % 10 = 0 GROUP BY user_id) SELECT e.user_id, event_id, coalesce(v, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS version FROM events e LEFT JOIN o ON o.user_id = e.user_id WHERE event_type = 'signup'",
    "language_facets": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "top_keys": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c) SELECT source, CAST(sum(n) AS BIGINT) AS n, string_agg(lang, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY source",
    "latency_by_type": "SELECT user_id, count(*) FILTER (event_type <> 'error') AS calls, round(avg(value) FILTER (event_type <> 'error'), 6) AS avg_latency, count(*) FILTER (event_type = 'error') AS denied FROM events GROUP BY user_id",
    "suspicious_reingest": "SELECT user_id, count(DISTINCT date_trunc('minute', ts)) AS minutes, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(DISTINCT date_trunc('minute', ts)) > 1 OR count(*) > 15",
    "user_totals": "SELECT u.user_id, count(s.user_id) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50) s ON s.user_id = u.user_id GROUP BY u.user_id",
    "task_stats": f"WITH {_RUNS} SELECT user_id, count(*) AS runs, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, round(coalesce(count(*) FILTER (status = 'success') / nullif(count(*) FILTER (status IN ('success', 'failed')), 0), 0), 6) AS success_rate FROM runs WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY user_id",
    "window_kpis": f"WITH {_RUNS}, r AS (SELECT *, ts >= TIMESTAMP '2024-01-20' AS recent FROM runs) SELECT count(*) AS total, count(*) FILTER (recent AND status = 'success') AS succeeded, count(*) FILTER (recent AND status = 'failed') AS failed, round(count(*) FILTER (recent AND status = 'success') / count(*) FILTER (recent AND status IN ('success', 'failed')), 6) AS success_rate, round(avg(value) FILTER (recent), 6) AS avg_latency FROM r",
    "corpus_chunk_counts": "WITH n AS (SELECT source, count(*) FILTER (lang = 'de' AND source <> 'src1') AS p, count(*) AS t FROM documents GROUP BY source) SELECT source, CASE WHEN p > 0 THEN p ELSE t END AS chunks FROM n UNION ALL SELECT 'empty', 0",
    "weekly_decay_rate": "SELECT round((avg(value) FILTER (ts < TIMESTAMP '2024-01-24') - avg(value)) * 100 / avg(value) FILTER (ts < TIMESTAMP '2024-01-24'), 6) AS decay_rate FROM events",
    "type_distribution": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT source, sum(n) AS total, max(n) AS most, arg_max(lang, (n, lang)) AS main_type, string_agg(lang || ':' || n, ',' ORDER BY lang) AS types FROM c GROUP BY source)
        SELECT source, CAST(total AS BIGINT) AS total, main_type, coalesce((SELECT max(n) FROM c WHERE c.source = m.source AND n < most) / total >= 0.3, false) AS conflict, types FROM m""",
    "centroids": "WITH e AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings), m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM e GROUP BY label, i) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS v FROM m",
    "ir_metrics": """WITH r AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS rank, count(*) OVER (PARTITION BY source) AS c FROM documents), k AS (SELECT query_id, id, 31 - (least(c, 30) - rank + 1) AS rank FROM r WHERE rank <= 30),
        rel AS (SELECT source AS query_id, d.doc_id AS id FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 1), tot AS (SELECT query_id, count(*) AS total FROM rel GROUP BY query_id),
        f AS (SELECT query_id, max(1.0::DOUBLE / rank) AS rr, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg, count(*) AS hits FROM k JOIN rel USING (query_id, id) WHERE rank <= 10 GROUP BY query_id)
        SELECT t.query_id, round(coalesce(rr, 0), 6) AS mrr, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM range(1, least(total, 10) + 1) x(i)), 6) AS ndcg, round(coalesce(hits, 0) / total, 6) AS recall, CAST(coalesce(hits, 0) > 0 AS INTEGER) AS hit FROM tot t LEFT JOIN f ON f.query_id = t.query_id""",
    "flag_summary": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS flags FROM c GROUP BY user_id",
    "type_entropy": "SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)",
    "pii_rate": r"SELECT count(*) AS total, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS flagged, round(count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) / count(*), 6) AS rate FROM documents",
    "first_event_per_user": "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "latest_events": "WITH r AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 4) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position FROM r",
    "sessions": "WITH l AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, s.session",
    "complete_indices": "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AS complete FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey",
    "failure_streaks": "WITH k AS (SELECT user_id, event_id, sum((event_type NOT IN ('error', 'view'))::INT) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS ok FROM events WHERE event_type <> 'signup') SELECT u.user_id, (SELECT count(*) FROM k WHERE k.user_id = u.user_id AND ok = 0) AS streak FROM (SELECT DISTINCT user_id FROM events) u",
    "no_progress": "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE value IS NOT NULL) SELECT user_id, coalesce(count(*) > 5 AND max(value) FILTER (r <= 5) <= max(value) FILTER (r > 5), false) AS stalled FROM r GROUP BY user_id",
    "oscillation": """WITH r AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 4), f AS (SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 0) AS flip FROM r)
        SELECT user_id, count(*) = 4 AND arg_max(value, event_id) <= arg_min(value, event_id) AND sum(flip) >= 2 AS oscillating FROM f GROUP BY user_id""",
    "break_groups": "WITH p AS (SELECT vec_id, vec_id % 7 AS k, label, lag(label) OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) AS prev FROM embeddings) SELECT vec_id, k, CAST(sum(coalesce((abs(label - prev) > 3)::INT, 0)) OVER (PARTITION BY k ORDER BY vec_id) AS BIGINT) AS grp FROM p",
    "budget_prefix": "SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM documents QUALIFY used <= 20000",
    "density_cap": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5",
    "turn_segments": "WITH s AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS segment FROM conversations) SELECT conv_id, segment, count(*) AS turns, md5(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn)) AS digest FROM s GROUP BY conv_id, segment",
    "latest_statuses": "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM events) SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS latest FROM r WHERE r <= 3 GROUP BY user_id",
    "reindexed_positions": "SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) * 1000 AS INTEGER) AS position FROM customer",
    "rate_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW) AS recent_calls FROM events QUALIFY recent_calls > 3",
    "keyset_page": "SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 500) ORDER BY ts DESC, event_id DESC LIMIT 21",
    "nulls_last_page": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS score FROM documents ORDER BY score DESC NULLS LAST, doc_id LIMIT 15 OFFSET 10",
    "proactive_recall": "WITH r AS (SELECT event_id, round(0.4::DOUBLE * value / 100 + greatest(0.0::DOUBLE, 1 - (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0::DOUBLE / 30) * 0.3::DOUBLE + least(1.0::DOUBLE, log2(1.0::DOUBLE + user_id % 20) / log2(101.0::DOUBLE)) * 0.2::DOUBLE + 0.1::DOUBLE, 6) AS rank_score FROM events WHERE value > 20) SELECT * FROM r ORDER BY rank_score DESC, event_id LIMIT 20",
    "replace_by_source": "SELECT doc_id, lang, source FROM documents WHERE NOT (source = 'src1' AND lang = 'en') UNION ALL SELECT doc_id + 1000000, lang, source FROM documents WHERE source = 'src1' AND lang = 'en'",
    "delete_by_source": "SELECT doc_id, source FROM documents WHERE source <> 'src2'",
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "upsert_relations": """WITH e AS (SELECT user_id AS source, event_id % 10 AS target, event_type AS type, value AS weight, value / 100 AS confidence, event_id AS seq FROM events), o AS (SELECT source, target, type, max(weight) AS weight, max(confidence) AS confidence, count(*) AS n FROM e WHERE seq % 3 = 0 GROUP BY ALL),
        f AS (SELECT source, target, type, arg_max(weight, seq) AS weight, arg_max(confidence, seq) AS confidence, count(*) AS n FROM e WHERE seq % 3 = 1 GROUP BY ALL)
        SELECT source, target, type, coalesce(f.weight, o.weight) AS weight, coalesce(f.confidence, o.confidence) AS confidence, f.n IS NOT NULL AS is_active, CASE WHEN f.n IS NULL THEN '2024-01-01' END AS valid_to, coalesce(o.n, 0) + coalesce(f.n, 0) AS observation_count FROM o FULL JOIN f USING (source, target, type)""",
    "compare_and_set": """WITH o AS (SELECT user_id, max(event_id % 5) AS version FROM events WHERE user_id % 3 <> 0 GROUP BY user_id), c AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 4 END AS expected FROM events), s AS (SELECT c.user_id, CAST(expected AS BIGINT) AS expected, version, CASE WHEN version IS NULL THEN 'missing' WHEN expected IS NULL OR expected = version THEN 'applied' ELSE 'conflict' END AS status FROM c LEFT JOIN o ON o.user_id = c.user_id)
        SELECT user_id, expected, status, CASE WHEN status = 'applied' THEN version + 1 ELSE version END AS version FROM s""",
    "hash_dedup": "SELECT doc_id, sha256(text) AS file_hash FROM documents QUALIFY row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) = 1",
    "set_operations": """WITH a AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, source FROM documents WHERE doc_id % 3 = 0)
        SELECT 'except_all' AS op, count(*) AS n FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'union', count(*) FROM (FROM a UNION FROM b)""",
}
