"""Archiving, supersession, builds, associations, document structure, formats and page elements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions import scoring as SC
from millrace.operators import aggregates as A
from millrace.operators import documents as D
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import memory as M
from millrace.operators import pii as P
from millrace.operators import web as H
from millrace.plans.materialize import shared_path
from millrace.sources import tables as S
from millrace.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def archived_by_source(spark, sf):
    d = _docs(spark, sf).select("doc_id", "source", (F.col("n_chars") % 5 == 0).alias("archived"))
    return S.archive_by_source(d, "source", "src1")


def upserted_summaries(spark, sf):
    e = _events(spark, sf)
    rows = lambda d: d.select(F.col("user_id").alias("corpus"), F.col("event_type").alias("community"), F.lit(0).alias("level"), F.col("event_id").alias("version"), F.md5("props").alias("summary"))
    return S.upsert_summaries(rows(e.where("event_id % 2 = 0")), rows(e.where("event_id % 2 = 1")), "version")


def written_batches(spark, sf):
    return S.append_in_batches(_docs(spark, sf).select("doc_id"), "doc_id").select("doc_id", "row_no", "batch")


def jsonl_documents(spark, sf):
    path = shared_path(spark, "jsonl")
    _docs(spark, sf).write.json(path)
    return S.read_jsonl(spark, path, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))


def supersession_history(spark, sf):
    later = F.lead("event_id").over(W.Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return J.supersession_history(_events(spark, sf).withColumn("superseded_by", later), "event_id", "superseded_by")


def authored_events(spark, sf):
    profiles = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.struct(F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name")).alias("profile"))).alias("state"))
    return J.with_profiles(_events(spark, sf).select("event_id", "user_id"), "user_id", profiles, "c_custkey", "state", "$.profile.name")


def build_health(spark, sf):
    status = F.element_at(F.array(*map(F.lit, ["completed", "completed_with_errors", "failed", "running"])), (F.col("event_id") % 4 + 1).cast("int"))
    end = F.when(F.col("event_id") % 4 < 3, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 600).cast("decimal(18,6)")))
    runs = _events(spark, sf).select("event_type", status.alias("status"), F.col("ts").alias("started_at"), end.alias("completed_at"))
    return A.build_health(runs, "event_type", F.to_timestamp_ntz(F.lit("2024-02-10")).cast("timestamp"))


def extraction_density(spark, sf):
    entities = F.regexp_count("text", F.lit("[A-Z][a-z]+"))
    return A.extraction_density(_docs(spark, sf).withColumn("n", entities), "source", F.col("n"), F.length("text")).withColumn("density_p95", F.round("density_p95", 6))


def graph_health(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 7).alias("vertices"), (F.col("n_nationkey") / 40).alias("isolated_ratio"), (F.col("n_nationkey") / 3000).alias("density"), (F.col("n_nationkey") / 12).alias("entropy"), (F.col("n_nationkey") / 25).alias("avg_confidence"))
    return G.health_score(rows, F.col("n_nationkey") / 24).select("n_nationkey", "health")


def access_updates(spark, sf):
    count, importance = SC.after_access("n", "importance")
    e = _events(spark, sf).select("event_id", (F.col("event_id") % 9).alias("n"), (F.col("event_id") % 101 / 100).alias("importance"))
    return e.select("event_id", count.alias("n"), F.round(importance, 6).alias("importance"))


def gated_texts(spark, sf):
    d = _docs(spark, sf).withColumn("redacted", F.when(F.col("doc_id") % 2 == 0, F.lit("[hidden]")))
    out = None
    for role in ("viewer", "editor", "admin", "nobody"):
        mine = P.gate(d, role, "text", "redacted").select("doc_id", F.lit(role).alias("role"), F.md5("visible").alias("digest"))
        out = mine if out is None else out.union(mine)
    return out


def seed_links(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return G.link_seeds(queries, e, 0.2, 5, "vec_id").withColumn("score", F.round("score", 6))


def association_hops(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"), F.when(F.col("l_linenumber") < 5, "semantic").otherwise("cites").alias("type"), (F.col("l_quantity") / 50).alias("weight"))
    return G.association_hops(e, spark.createDataFrame([("s1",), ("p2",)], "id string"), 2, 0.6)


def similar_facts(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("confidence", F.col("vec_id") % 13)
    return M.merge_similar_facts(e, "label", "vec_id", "embedding", "confidence", 0.25)


def structure_reports(spark, sf):
    n = F.col("doc_id") % 4
    source = F.concat(F.lit("# Title\n"), F.col("text"), F.lit("\n![i](http://x.org/a.png) [l](<http://y.org/b>) http://z.org/c http://z.org/c"))
    translated = F.concat(F.when(n == 1, F.lit("Title\n")).otherwise(F.lit("# Title\n")), F.col("text"), F.when(n == 2, F.lit("\n[l](http://y.org/b) http://z.org/c")).otherwise(F.lit("\n![i](http://x.org/a.png) [l](<http://y.org/b>) http://z.org/c http://z.org/c")))
    d = _docs(spark, sf).select("doc_id", source.alias("a"), translated.alias("b"))
    out = D.structure_report("a", "b")
    return d.select("doc_id", *[(F.array_join(v, ",") if k == "urls_missing" else v).alias(k) for k, v in out.items()])


def algorithm_scores(spark, sf):
    n = F.col("doc_id") % 4
    head = F.when(n == 0, F.lit("Algorithm 1 Sort\nRequire: a list\n1: for each x do\n2: return x ← y ≤ z\n")).when(n == 1, F.lit("if a then\nreturn b\n")).when(n == 2, F.lit("| --- |\n")).otherwise(F.lit(""))
    return _docs(spark, sf).select("doc_id", D.algorithm_score(F.concat(head, F.col("text"))).alias("score"))


def page_slices(spark, sf):
    return D.page_ranges(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 8)


def merged_assets(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("doc"), F.col("l_linenumber").alias("slice"), F.concat(F.lit("img"), F.col("l_partkey") % 50).alias("name"), F.md5((F.col("l_suppkey") % 4).cast("string")).alias("sha"), "l_orderkey", "l_partkey", "l_suppkey")
    return D.merge_assets(li, "doc", "slice", "name", "sha", ["l_orderkey", "l_partkey", "l_suppkey"]).groupBy("doc", "slice", "new_name").agg(F.count(F.lit(1)).alias("n"))


def feed_records(spark, sf):
    day = F.when(F.col("doc_id") % 3 == 0, "2024-01-05T00:00:00Z").when(F.col("doc_id") % 3 == 1, "2020-01-05T00:00:00Z").otherwise("soon")
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/'), F.col("doc_id").cast("string"), F.lit("v1</id><title> A\n title </title><published>"), day, F.lit('</published><author><name>Ann</name></author><link title="pdf" href="http://p/'), F.col("doc_id").cast("string"), F.lit('"/></entry></feed>'))
    return D.feed_records(_docs(spark, sf).select("doc_id", xml.alias("xml")), "xml", ["doc_id"], "2023-01-01").select("doc_id", "id", "title", F.array_join("authors", ",").alias("authors"), "pdf_url", "published")


def _planted(spark, sf):
    html = F.concat(F.lit('<html><body><h1 class="t big">Head '), F.col("page_id").cast("string"), F.lit('</h1><div id="m"><p class="x">One</p><p>Two <a href="/l">link</a></p></div><table><tr><th>K</th></tr><tr><td>v'), F.col("page_id").cast("string"), F.lit('</td></tr></table><pre><code class="language-py">x = 1</code></pre><img src="/i.png" alt="pic"><script type="math/tex; mode=display">a^2</script><p>cost $x+'), F.col("page_id").cast("string"), F.lit("$ here</p></body></html>"))
    return table(spark, sf, "pages").select("page_id", "url", html.alias("html"))


def selected_elements(spark, sf):
    found = H.select(_planted(spark, sf), {"title": {"selector": "h1.big", "attr": "text"}, "paragraphs": "#m p", "links": {"selector": "p a", "attr": "href", "multiple": True}}, ["page_id"])
    return found.select("page_id", *[F.array_join(F.col("found")[k], "|").alias(k) for k in ("title", "paragraphs", "links")])


def page_formulas(spark, sf):
    return H.page_math(_planted(spark, sf), ["page_id"])


def planted_tables(spark, sf):
    return H.page_tables(_planted(spark, sf), ["page_id"]).select("page_id", "table_index", F.array_join("header", "|").alias("header"), F.array_join(F.flatten("rows"), "|").alias("cells"))


def planted_code(spark, sf):
    return H.page_code(_planted(spark, sf), ["page_id"])


def planted_images(spark, sf):
    return H.page_images(_planted(spark, sf), ["page_id"]).select("page_id", "alt")


def formatted_texts(spark, sf):
    text = F.concat(F.lit("#Head\n* one\n* two  words\n```\n*  code  x\n```\n>quoted "), F.col("doc_id").cast("string"))
    return D.formatted(_docs(spark, sf).select("doc_id", text.alias("text")), "text", ["doc_id"])


def restored_fences(spark, sf):
    n = F.col("doc_id").cast("string")
    source = F.concat(F.lit("Intro\n```py\nprint("), n, F.lit(")\n```\nEnd\n"))
    moved = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Anfang\n```py\ndrucke("), n, F.lit(")\n```\nEnde\n"))).otherwise(F.lit("Anfang\nEnde\n"))
    return D.restored(_docs(spark, sf).select("doc_id", source.alias("a"), moved.alias("b")), "a", "b", ["doc_id"])


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

_COSINE = "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"
_LINES = r"list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '\S'))"
_KEYWORDS = r"(?i)(?:^|\s)(?:(?:if|then|else|while|do|repeat|until|return|function|procedure|begin|call)(?:$|[^\p{L}\p{N}_])|end\s+(?:if|for|while|function|procedure|loop)(?:$|[^\p{L}\p{N}_])|for\s+[\p{L}\p{N}_])"
SQL = {
    "archived_by_source": "SELECT doc_id, source, coalesce(source = 'src1' OR n_chars % 5 = 0, false) AS archived FROM documents",
    "upserted_summaries": "SELECT user_id AS corpus, event_type AS community, 0 AS level, max(event_id) AS version, arg_max(md5(props), event_id) AS summary FROM events GROUP BY user_id, event_type",
    "written_batches": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_no, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM documents",
    "jsonl_documents": "SELECT doc_id, lang, n_chars, md5(text) AS digest FROM documents",
    "supersession_history": "WITH f AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events) SELECT nxt AS event_id, event_id AS superseded_id FROM f WHERE nxt IS NOT NULL",
    "authored_events": "SELECT event_id, user_id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, CAST(user_id AS VARCHAR)) AS author FROM events LEFT JOIN customer ON c_custkey = user_id",
    "build_health": "SELECT event_type, count(*) AS total_runs, round(count(*) FILTER (WHERE event_id % 4 < 2) / count(*), 3) AS success_rate, round(coalesce(avg(CASE WHEN event_id % 4 < 3 THEN event_id % 600 END), 0), 1) AS avg_duration_sec FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY event_type",
    "extraction_density": "WITH d AS (SELECT source, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n, length(text) AS l FROM documents) SELECT source, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS entities, round(quantile_cont(n / nullif(l, 0) * 1000, 0.95), 6) AS density_p95 FROM d GROUP BY source",
    "graph_health": "SELECT n_nationkey, CAST(trunc(least(n_nationkey * 7 / 100, 1) * 25 + greatest(0, 1 - n_nationkey / 40 / 0.4::DOUBLE) * 20 + least(n_nationkey / 3000 / 0.005::DOUBLE, 1) * 10 + least(n_nationkey / 12 / 1.5::DOUBLE, 1) * 15 + least(n_nationkey / 25 / 0.8::DOUBLE, 1) * 15 + least(n_nationkey / 24 / 0.95::DOUBLE, 1) * 15) AS INTEGER) AS health FROM nation",
    "access_updates": "SELECT event_id, event_id % 9 + 1 AS n, round(least(1.0::DOUBLE, event_id % 101 / 100 + 0.02::DOUBLE), 6) AS importance FROM events",
    "gated_texts": "SELECT doc_id, role, md5(CASE WHEN role IN ('editor', 'admin') OR doc_id % 2 = 1 THEN text ELSE '[hidden]' END) AS digest FROM documents, (VALUES ('viewer'), ('editor'), ('admin'), ('nobody')) r(role)",
    "seed_links": f"WITH p AS (SELECT y.vec_id AS query_id, x.vec_id AS id, {_COSINE} AS score FROM embeddings x, embeddings y WHERE y.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM p) SELECT query_id, id, round(score, 6) AS score FROM r WHERE r <= 5 AND score >= 0.2",
    "association_hops": "WITH RECURSIVE e AS (SELECT 'p' || l_partkey AS s, 's' || l_suppkey AS t FROM lineitem WHERE l_linenumber < 5 AND l_quantity / 50 >= 0.6), b AS (SELECT s, t FROM e UNION SELECT t, s FROM e), w(id, distance) AS (SELECT * FROM (VALUES ('s1', 0), ('p2', 0)) UNION SELECT t, distance + 1 FROM w JOIN b ON s = id WHERE distance < 2) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY id HAVING min(distance) > 0",
    "similar_facts": f"WITH p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND (x.vec_id % 13, -x.vec_id) > (y.vec_id % 13, -y.vec_id) WHERE {_COSINE} >= 0.25) SELECT b AS loser, arg_min(a, (-(a % 13), a)) AS winner FROM p GROUP BY b",
    "structure_reports": r"WITH h AS (SELECT doc_id, len(regexp_extract_all(text, '(?m)^ {0,3}#{1,6}\s')) AS h, doc_id % 4 AS n FROM documents) SELECT doc_id, CAST(h + 1 AS INTEGER) AS headings_src, CAST(h + CASE WHEN n = 1 THEN 0 ELSE 1 END AS INTEGER) AS headings_dst, CASE WHEN n = 2 THEN 1 ELSE 0 END AS images_missing, CASE WHEN n = 2 THEN 'http://x.org/a.png,http://x.org/a.png,http://z.org/c' ELSE '' END AS urls_missing, n = 1 AS drift, n = 2 AS fatal FROM h",
    "algorithm_scores": rf"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Algorithm 1 Sort' || chr(10) || 'Require: a list' || chr(10) || '1: for each x do' || chr(10) || '2: return x ← y ≤ z' || chr(10) WHEN 1 THEN 'if a then' || chr(10) || 'return b' || chr(10) WHEN 2 THEN '| --- |' || chr(10) ELSE '' END || text AS t FROM documents),
        s AS (SELECT doc_id, t, {_LINES} AS l, regexp_matches(ltrim(t), '(?i)^(?:Algorithm|Procedure|Function|Subroutine|Listing)\s+\d+') AS titled, regexp_matches(t, '(?im)^(?:Require|Ensure|Input|Output|Precondition|Postcondition)\s*:') AS headed, len(regexp_extract_all(t, '[←→≠≤≥∅▷◃∈∉∀∃⊂⊃∪∩∧∨≜≝≐⊕⊗]')) AS special FROM d),
        c AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '^\s*\d+\s*:\s+\S'))) AS numbered, len(list_filter(l, lambda x: regexp_matches(x, '{_KEYWORDS}'))) AS keywords, len(l) AS n, list_sum(list_transform(l, lambda x: length(x))) / nullif(len(l), 0) AS mean FROM s)
        SELECT doc_id, CAST(CASE WHEN n = 0 OR regexp_matches(t, '(?m)^\|[\s-]+\|') THEN 0 ELSE titled::INT * 5 + headed::INT * 3 + least(numbered, 5) + least(keywords, 5) + (special >= 2)::INT * 2 - (mean > 120)::INT * 3 - (n < 3 AND NOT titled)::INT * 2 - (NOT (titled OR headed OR numbered >= 2 OR special >= 2))::INT * 4 END AS INTEGER) AS score FROM c""",
    "page_slices": "SELECT p_partkey, p_size, CAST(s AS INTEGER) AS start, CAST(least(s + 8, p_size) AS INTEGER) AS \"end\" FROM (SELECT p_partkey, p_size, unnest(range(0, p_size, 8)) AS s FROM part)",
    "merged_assets": "WITH a AS (SELECT l_orderkey % 10 AS doc, l_linenumber AS slice, 'img' || l_partkey % 50 AS name, md5(CAST(l_suppkey % 4 AS VARCHAR)) AS sha, l_orderkey, l_partkey, l_suppkey FROM lineitem), m AS (SELECT *, first_value(sha) OVER w AS f, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY doc, name ORDER BY slice, l_orderkey, l_partkey, l_suppkey)) SELECT doc, slice, CASE WHEN n = 1 THEN name ELSE 'b' || slice || '_' || name END AS new_name, count(*) AS n FROM m WHERE n = 1 OR sha <> f GROUP BY ALL",
    "feed_records": "SELECT doc_id, doc_id || 'v1' AS id, 'A title' AS title, 'Ann' AS authors, 'http://p/' || doc_id AS pdf_url, CASE WHEN doc_id % 3 = 0 THEN '2024-01-05T00:00:00Z' ELSE 'soon' END AS published FROM documents WHERE doc_id % 3 <> 1",
    "selected_elements": "SELECT page_id, 'Head ' || page_id AS title, 'One|Two link' AS paragraphs, '/l' AS links FROM pages",
    "page_formulas": "SELECT page_id, 'a^2' AS latex, true AS display, 'script' AS origin FROM pages UNION ALL SELECT page_id, 'x+' || page_id, false, 'text' FROM pages",
    "planted_tables": "SELECT page_id, 0 AS table_index, 'K' AS header, 'v' || page_id AS cells FROM pages",
    "planted_code": "SELECT page_id, 'py' AS language, 'x = 1' AS code FROM pages",
    "planted_images": "SELECT page_id, 'pic' AS alt FROM pages",
    "formatted_texts": "SELECT doc_id, '# Head' || chr(10) || chr(10) || '- one' || chr(10) || '- two words' || chr(10) || '```' || chr(10) || '*  code  x' || chr(10) || '```' || chr(10) || '> quoted ' || doc_id || chr(10) AS formatted FROM documents",
    "restored_fences": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Anfang' || chr(10) || '```py' || chr(10) || 'print(' || doc_id || ')' || chr(10) || '```' || chr(10) || 'Ende' || chr(10) ELSE 'Anfang' || chr(10) || 'Ende' || chr(10) END AS restored, doc_id % 2 = 0 AS restorable FROM documents",
}
