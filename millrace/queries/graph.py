"""Graph queries over customers, suppliers and their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators.leiden import community_levels
from millrace.plans.materialize import materialize, shuffle_parts
from millrace.sources.tables import table

_SQL_EDGES = "e AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, min(o_orderpriority) AS type, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
_SQL_BOTH = _SQL_EDGES + ", b AS (SELECT source AS src, target AS dst, weight, type FROM e UNION ALL SELECT target, source, weight, type FROM e)"


#: Edges of this process by application and tables: written once, read by all graph queries.
_EDGES: dict = {}
#: Order lines that a task joins and adds up.
LINES = 200_000


def _edges(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _EDGES:
        _EDGES[key] = materialize(_joined(spark, sf))
    return _EDGES[key]


def _edge_parts(spark, lines: int) -> int:
    """Partitions in which edges are made: more lines need more of them, not more memory of a task."""
    return max(shuffle_parts(spark), -(-lines // LINES))


def _joined(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("c"), F.col("o_custkey")).alias("source"), "o_orderpriority")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"), "l_quantity")
    parts = _edge_parts(spark, table(spark, sf, "lineitem").count())
    if parts > shuffle_parts(spark):
        o, li = o.repartition(parts, "k"), li.repartition(parts, "k")
        return o.join(li.hint("merge"), "k").repartition(parts, "source", "target").groupBy("source", "target").agg(F.min("o_orderpriority").alias("type"), F.sum("l_quantity").alias("weight"))
    return o.join(li, "k").groupBy("source", "target").agg(F.min("o_orderpriority").alias("type"), F.sum("l_quantity").alias("weight"))


def _vertices(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("importance"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("importance"))
    return c.union(s)


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def graph_neighbours(spark, sf):
    return G.neighbours(_edges(spark, sf), _seeds(spark, "s1"), 3)


def graph_one_hop(spark, sf):
    return G.one_hop(_edges(spark, sf), "s2", 15)


def graph_shortest_paths(spark, sf):
    return G.shortest_paths(_edges(spark, sf), _seeds(spark, "s1", "s5"), 3).withColumn("path", F.array_join("path", ">"))


def graph_evidence_chains(spark, sf):
    return G.evidence_chains(_edges(spark, sf), _seeds(spark, "s1"), _vertices(spark, sf).where("kind = 'supplier'"), 2)


def graph_subgraph(spark, sf):
    v, e = G.subgraph(_vertices(spark, sf), _edges(spark, sf), "s3", 2, 40, "importance")
    return v.select("id", "distance", F.lit("vertex").alias("part")).union(e.select(F.concat_ws(">", "source", "target"), F.lit(-1), F.lit("edge")))


def graph_pagerank(spark, sf):
    return G.pagerank(_edges(spark, sf), iterations=8, tolerance=0.0).withColumn("score", F.round("score", 9))


def graph_personalized_pagerank(spark, sf):
    e = _edges(spark, sf)
    both = G.both_ways(e, "weight").select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")
    return G.pagerank(both, _seeds(spark, "s1", "s2"), iterations=6, tolerance=0.0).withColumn("score", F.round("score", 9))


def graph_decay_expansion(spark, sf):
    return G.decay_expansion(_edges(spark, sf).withColumn("weight", F.col("weight") / 100), _seeds(spark, "s1"), 2, 0.5, 30).withColumn("score", F.round("score", 6))


def graph_spread_to_items(spark, sf):
    scores = G.decay_expansion(_edges(spark, sf).withColumn("weight", F.col("weight") / 100), _seeds(spark, "s1"), 1, 0.5, 1000)
    mentions = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("entity_id"), F.col("o_orderpriority").alias("item_id"), F.lit(0.5).alias("weight"))
    return G.spread_to_items(scores, mentions).withColumn("score", F.round("score", 5))


def graph_communities(spark, sf):
    e = _edges(spark, sf)
    labels = G.communities(e, 1.0, 8)
    return labels.groupBy("community").agg(F.count(F.lit(1)).alias("n"))


def graph_components(spark, sf):
    return G.weak_components(_vertices(spark, sf), _edges(spark, sf).where("weight > 49.5"))


def graph_statistics(spark, sf):
    out = G.statistics(_vertices(spark, sf), _edges(spark, sf).withColumn("confidence", F.col("weight") / 100))
    out = G.health_score(out, F.lit(0.9))
    return out.select("vertices", "edges", *[F.round(c, 6).alias(c) for c in ("isolated_ratio", "avg_confidence", "entropy", "density", "avg_degree")], "health")


def graph_quality(spark, sf):
    v = _vertices(spark, sf).where("id not in ('s1', 's2', 'c10')")
    e = _edges(spark, sf).withColumn("confidence", F.col("weight") / 100)
    mentions = table(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id")
    out = G.quality(v, e, mentions, table(spark, sf, "documents"), F.col("type") != "1-URGENT")
    return out.select("dangling", "orphans", *[F.round(c, 6).alias(c) for c in ("coverage", "confidence", "evidence")], F.round("quality", 3).alias("quality"))


def graph_temporal_verdicts(spark, sf):
    e = _edges(spark, sf).withColumn("evidence", F.col("weight").cast("int").cast("string"))
    old = e.where("substring(source, -1, 1) in ('1', '2', '3')").withColumn("evidence", F.when(F.col("weight") > 49, F.lit("x")).otherwise(F.col("evidence")))
    return G.resolve_temporal(old, e.where("substring(source, -1, 1) in ('2', '3', '4')"), ["1-URGENT"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def graph_rewritten_edges(spark, sf):
    merges = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("old"), F.concat(F.lit("s"), F.col("s_suppkey") - 1).alias("new"))
    kept = _vertices(spark, sf).join(merges.select(F.col("old").alias("id")), "id", "left_anti")
    return G.rewrite_endpoints(_edges(spark, sf), merges, kept)


def graph_merged_entities(spark, sf):
    v = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("mentions"), F.col("s_acctbal").alias("confidence"))
    merges = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("old"), F.concat(F.lit("s"), F.col("s_suppkey") - 1).alias("new"))
    return G.merge_entities(v, merges).withColumn("aliases", F.array_join("aliases", ","))


def graph_synced_entities(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("name"), (F.col("value") / 100).alias("confidence"))
    return G.sync_entities(e)


def graph_context(spark, sf):
    return G.context_triples(_edges(spark, sf), _seeds(spark, "s1", "s2", "s3"), 600)


def graph_publication_slice(spark, sf):
    li = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("entity_id"), F.col("o_orderkey").alias("doc_id"))
    kept, edges, more = G.publication_slice(li, li.where("doc_id % 4 = 0").select("doc_id").distinct(), _edges(spark, sf), 25)
    return kept.select("id", "mentions").crossJoin(more)


def graph_community_levels(spark, sf):
    return community_levels(_edges(spark, sf))


def graph_community_summaries(spark, sf):
    return G.community_summaries(table(spark, sf, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("importance")))


def graph_hits_to_works(spark, sf):
    hits = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad((F.col("user_id") % 30).cast("string"), 5, "0")).alias("uri"), F.col("value").alias("score"))
    return G.hits_to_works(hits, "uri")


def graph_multi_hop(spark, sf):
    v = _vertices(spark, sf).withColumn("name", F.col("id"))
    out = G.multi_hop(_edges(spark, sf), v.where("kind = 'customer'"), "How is c3001x related to c1?", 10, 3, 5)
    return out.select("id", F.size("path").alias("steps"))


def catalog_tree(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), "n_name")
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("n"), F.col("s_nationkey")), "s_name")
    return G.tree(r.union(n).union(s), F.col("parent").isNull()).withColumn("path", F.array_join("path", "/"))


def navigation_tree(spark, sf):
    d = table(spark, sf, "documents").select(F.array("lang", "source", F.concat(F.lit("d"), F.col("doc_id"))).alias("path")).union(table(spark, sf, "documents").select(F.array("lang")).distinct())
    return G.navigation(d, "path").where("depth < 3").withColumn("path", F.array_join("path", "/"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}


def _pagerank_sql(edges: str, seeds: str | None, iterations: int) -> str:
    p = f"CASE WHEN id IN ({seeds}) THEN 1.0::DOUBLE / {seeds.count(',') + 1} ELSE 0.0::DOUBLE END" if seeds else "1.0::DOUBLE / count(*) OVER ()"
    out = f"WITH {edges}, sh AS MATERIALIZED (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM g), v AS MATERIALIZED (SELECT id, {p} AS p, 1.0::DOUBLE / count(*) OVER () AS s0, id IN (SELECT source FROM g) AS has_out FROM (SELECT source AS id FROM g UNION SELECT target FROM g)), x0 AS (SELECT id, p, has_out, s0 AS score FROM v)"
    for i in range(iterations):
        out += f", x{i + 1} AS MATERIALIZED (SELECT x.id, p, has_out, 0.85::DOUBLE * (coalesce(got, 0) + p * coalesce((SELECT sum(score) FROM x{i} WHERE NOT has_out), 0)) + 0.15::DOUBLE * p AS score FROM x{i} x LEFT JOIN (SELECT target, sum(score * share) AS got FROM x{i} JOIN sh ON source = id GROUP BY target) m ON m.target = x.id)"
    return f"{out} SELECT id, round(score, 9) AS score FROM x{iterations}"


SQL = {
    "graph_neighbours": f"WITH RECURSIVE {_SQL_BOTH}, w(id, distance) AS (SELECT 's1', 0 UNION SELECT dst, distance + 1 FROM w JOIN b ON src = id WHERE distance < 3) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY id",
    "graph_one_hop": f"WITH {_SQL_EDGES} SELECT * FROM (SELECT target AS id, 'out' AS direction, weight FROM e WHERE source = 's2' UNION ALL SELECT source, 'in', weight FROM e WHERE target = 's2') ORDER BY weight DESC, id, direction LIMIT 15",
    "graph_shortest_paths": f"WITH RECURSIVE {_SQL_BOTH}, w(id, distance, path) AS (SELECT unnest(['s1', 's5']), 0, [unnest(['s1', 's5'])] UNION ALL SELECT dst, distance + 1, path || [dst] FROM w JOIN (SELECT DISTINCT src, dst FROM b) ON src = id WHERE distance < 3 AND NOT list_contains(path, dst) AND dst NOT IN ('s1', 's5')), m AS (SELECT id, min(distance) AS d FROM w GROUP BY id) SELECT w.id, CAST(d AS INTEGER) AS distance, array_to_string(min(path), '>') AS path FROM w JOIN m ON m.id = w.id AND d = distance GROUP BY w.id, d",
    "graph_evidence_chains": f"WITH {_SQL_BOTH}, d AS (SELECT DISTINCT src, dst FROM b), p AS (SELECT x.dst AS mid, y.dst AS t FROM d x JOIN d y ON y.src = x.dst WHERE x.src = 's1' AND y.dst <> 's1' AND y.dst LIKE 's%'), q AS (SELECT t, min(mid) AS mid FROM p GROUP BY t), h AS (SELECT t AS target_id, 0 AS hop, 's1' AS source, mid AS dest FROM q UNION ALL SELECT t, 1, mid, t FROM q), w AS (SELECT src, dst, max((weight, type)) AS w FROM b GROUP BY src, dst) SELECT target_id, CAST(hop AS INTEGER) AS hop, source, dest, w[1] AS weight, w[2] AS type FROM h JOIN w ON src = source AND dst = dest",
    "graph_subgraph": f"WITH RECURSIVE {_SQL_BOTH}, w(id, distance) AS (SELECT 's3', 0 UNION SELECT dst, distance + 1 FROM w JOIN b ON src = id WHERE distance < 2), m AS (SELECT id, min(distance) AS distance FROM w GROUP BY id), v AS (SELECT 'c' || c_custkey AS id, c_acctbal AS importance FROM customer UNION ALL SELECT 's' || s_suppkey, s_acctbal FROM supplier), k AS (SELECT m.id, distance FROM m JOIN v ON v.id = m.id ORDER BY distance, importance DESC, m.id LIMIT 40) SELECT id, CAST(distance AS INTEGER) AS distance, 'vertex' AS part FROM k UNION ALL SELECT source || '>' || target, -1, 'edge' FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)",
    "graph_pagerank": _pagerank_sql(f"{_SQL_EDGES}, g AS (SELECT source, target, weight FROM e)", None, 8),
    "graph_personalized_pagerank": _pagerank_sql(f"{_SQL_BOTH}, g AS (SELECT src AS source, dst AS target, sum(weight) AS weight FROM b GROUP BY src, dst)", "'s1', 's2'", 6),
    "graph_decay_expansion": f"WITH {_SQL_BOTH}, l1 AS (SELECT dst AS id, 0.5::DOUBLE * max(weight / 100) AS score FROM b WHERE src = 's1' GROUP BY dst), l2 AS (SELECT dst AS id, 0.25::DOUBLE * max(weight / 100) AS score FROM b WHERE src IN (SELECT id FROM l1) AND dst <> 's1' AND dst NOT IN (SELECT id FROM l1) GROUP BY dst), a AS (SELECT 's1' AS id, 1.0::DOUBLE AS score UNION ALL FROM l1 UNION ALL FROM l2) SELECT id, round(score / (SELECT max(score) FROM a), 6) AS score FROM a ORDER BY a.score DESC, id LIMIT 30",
    "graph_spread_to_items": f"WITH {_SQL_BOTH}, a AS (SELECT 's1' AS id, 1.0::DOUBLE AS score UNION ALL SELECT dst, 0.5::DOUBLE * max(weight / 100) FROM b WHERE src = 's1' GROUP BY dst), n AS (SELECT id, score / (SELECT max(score) FROM a) AS score FROM a) SELECT o_orderpriority AS item_id, round(sum(score * 0.5::DOUBLE), 5) AS score FROM n JOIN orders ON 'c' || o_custkey = id GROUP BY o_orderpriority",
    "graph_components": f"WITH RECURSIVE {_SQL_BOTH}, h AS (SELECT src, dst FROM b WHERE weight > 49.5), v AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier), w(id, r) AS (SELECT id, id FROM v UNION SELECT w.id, dst FROM w JOIN h ON src = r) SELECT id, min(r) AS component FROM w GROUP BY id",
    "graph_statistics": f"WITH {_SQL_EDGES}, v AS (SELECT 'c' || c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier), c AS (SELECT count(*) AS vertices, avg((id NOT IN (SELECT source FROM e) AND id NOT IN (SELECT target FROM e))::INT::DOUBLE) AS isolated_ratio FROM v), x AS (SELECT count(*) AS edges, avg(weight / 100) AS avg_confidence FROM e), h AS (SELECT -sum(p * log2(p)) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM v GROUP BY kind)), r AS (SELECT *, round(edges / (vertices * (vertices - 1)), 4) AS density, edges * 2 / vertices AS avg_degree FROM c, x, h) SELECT vertices, edges, round(isolated_ratio, 6) AS isolated_ratio, round(avg_confidence, 6) AS avg_confidence, round(entropy, 6) AS entropy, round(density, 6) AS density, round(avg_degree, 6) AS avg_degree, CAST(trunc(least(vertices / 100, 1) * 25 + greatest(0, 1 - isolated_ratio / 0.4::DOUBLE) * 20 + least(density / 0.005::DOUBLE, 1) * 10 + least(entropy / 1.5::DOUBLE, 1) * 15 + least(avg_confidence / 0.8::DOUBLE, 1) * 15 + 0.9::DOUBLE / 0.95::DOUBLE * 15) AS INTEGER) AS health FROM r",
    "graph_quality": f"WITH {_SQL_EDGES}, v AS (SELECT id FROM (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier) WHERE id NOT IN ('s1', 's2', 'c10')), r AS (SELECT (SELECT count(*) FROM e WHERE source NOT IN (SELECT id FROM v) OR target NOT IN (SELECT id FROM v)) AS dangling, (SELECT count(*) FROM v WHERE id NOT IN (SELECT source FROM e) AND id NOT IN (SELECT target FROM e)) AS orphans, (SELECT avg((doc_id % 3 = 0)::INT::DOUBLE) FROM documents) AS coverage, (SELECT avg(weight / 100) FROM e) AS confidence, (SELECT avg((type <> '1-URGENT')::INT::DOUBLE) FROM e) AS evidence) SELECT dangling, orphans, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, round(evidence, 6) AS evidence, round(round(0.4::DOUBLE * (1 - (dangling + orphans) / ((SELECT count(*) FROM e) + (SELECT count(*) FROM v))) + 0.2::DOUBLE * (coverage + confidence + evidence), 4), 3) AS quality FROM r",
    "graph_temporal_verdicts": f"WITH {_SQL_EDGES}, x AS (SELECT source, target, type, CAST(CAST(trunc(weight) AS INTEGER) AS VARCHAR) AS evidence, weight FROM e), o AS (SELECT source, target, type, CASE WHEN weight > 49 THEN 'x' ELSE evidence END AS evidence FROM x WHERE right(source, 1) IN ('1', '2', '3')), n AS (SELECT * FROM x WHERE right(source, 1) IN ('2', '3', '4')) SELECT CASE WHEN o.source IS NOT NULL AND o.evidence = n.evidence THEN 'reinforce' WHEN o.source IS NOT NULL THEN 'update' WHEN n.type = '1-URGENT' AND EXISTS (SELECT 1 FROM o p WHERE p.source = n.source AND p.type = n.type AND p.target <> n.target) THEN 'contradict' ELSE 'new' END AS verdict, count(*) AS n FROM n LEFT JOIN o ON o.source = n.source AND o.target = n.target AND o.type = n.type GROUP BY 1",
    "graph_rewritten_edges": f"WITH {_SQL_EDGES}, x AS (SELECT source, CASE WHEN CAST(target[2:] AS INTEGER) % 3 = 0 THEN 's' || (CAST(target[2:] AS INTEGER) - 1) ELSE target END AS target, type, weight FROM e) SELECT source, target, type, sum(weight) AS weight FROM x WHERE target <> 's-1' GROUP BY ALL",
    "graph_merged_entities": "WITH m AS (SELECT s_suppkey - (s_suppkey % 3 = 0)::INT AS t, * FROM supplier) SELECT 's' || t AS id, max(s_name) FILTER (t = s_suppkey) AS name, CAST(sum(s_suppkey) AS BIGINT) AS mentions, max(s_acctbal) AS confidence, coalesce(string_agg(s_name, ',' ORDER BY s_name) FILTER (t <> s_suppkey), '') AS aliases FROM m GROUP BY t",
    "graph_synced_entities": "WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END AS name, value / 100 AS confidence FROM events) SELECT lower(trim(name)) AS canonical, arg_max(name, (confidence, name)) AS name, max(confidence) AS confidence, count(*) AS mentions FROM e GROUP BY 1",
    "graph_context": f"WITH {_SQL_BOTH}, r AS (SELECT src, dst, type, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, type) AS r FROM b WHERE src IN ('s1', 's2', 's3')) SELECT src, CAST(r AS INTEGER) AS r, '- ' || src || ' [' || type || '] ' || dst AS line FROM r WHERE r <= 5 ORDER BY src, r.r LIMIT 13",
    "graph_publication_slice": "WITH c AS (SELECT 'c' || o_custkey AS id, count(*) AS mentions FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) SELECT id, mentions, (SELECT count(*) FROM c) > 25 AS truncated FROM c ORDER BY mentions DESC, id LIMIT 25",
    "graph_community_summaries": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS r FROM customer) SELECT c_nationkey AS community, count(*) AS n, 'Community of ' || count(*) || ' related entities: ' || string_agg(c_name, ', ' ORDER BY r) FILTER (r <= 5) AS summary FROM r GROUP BY c_nationkey",
    "graph_hits_to_works": "WITH w AS (SELECT '2401.' || lpad(CAST(user_id % 30 AS VARCHAR), 5, '0') AS work, max(value) AS score, arg_max(event_id, (value, event_id)) AS id FROM events GROUP BY 1) SELECT work, score, id, CAST(row_number() OVER (ORDER BY score DESC, work) AS INTEGER) AS rank FROM w",
    "catalog_tree": "SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 's' || s_suppkey, 2, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    "navigation_tree": "SELECT lang AS path, 1 AS depth, count(*) + 1 AS entries, false AS synthetic FROM documents GROUP BY lang UNION ALL SELECT lang || '/' || source, 2, count(*), true FROM documents GROUP BY lang, source",
}
