"""Search queries: vector 0 and a few common words, over documents and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators import fulltext as I
from millrace.operators import search as S
from millrace.plans.materialize import shared_path
from millrace.sources.tables import table

TERMS = ["the", "and"]
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")


def _query(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("score",)})


SEM = "sem_all AS (SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
KEY = f"key_all AS (SELECT doc_id AS id, CAST(len(list_filter({TOKENS}, lambda x: x IN ('the', 'and'))) AS DOUBLE) AS score FROM documents WHERE list_contains({TOKENS}, 'the') AND list_contains({TOKENS}, 'and'))"


def vector_topk(spark, sf):
    return _round(S.vector_topk(_items(spark, sf), _query(spark, sf), 20))


def vector_topk_filtered(spark, sf):
    return _round(S.vector_topk(_items(spark, sf), _query(spark, sf), 10, where=F.col("label") == 3, min_score=0.05))


def vector_topk_many(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _round(S.vector_topk_many(_items(spark, sf), asked, 5)).select("query_id", "id", "score", "rank")


def cosine_columns(spark, sf):
    e = _items(spark, sf)
    pair = e.select(F.col("id").alias("a"), F.col("embedding").alias("x")).join(e.select((F.col("id") - 1).alias("a"), F.col("embedding").alias("y")), "a")
    return pair.select("a", F.round(V.cosine_similarity("x", "y"), 6).alias("cosine"), F.round(V.cosine_distance("x", "y"), 6).alias("distance"), F.round(V.norm("x"), 6).alias("norm"))


def keyword_topk(spark, sf):
    return S.keyword_topk(_docs(spark, sf), TERMS, 20)


def hybrid_linear(spark, sf):
    items = _items(spark, sf).join(_docs(spark, sf), "id")
    return _round(S.hybrid_search(items, _query(spark, sf), TERMS, 10), "semantic_score", "keyword_score", "score")


def rrf_search(spark, sf):
    found = S.rrf_search(_items(spark, sf).join(_docs(spark, sf), "id"), _query(spark, sf), TERMS, 10)
    return _round(found).join(_docs(spark, sf).select("id", "lang"), "id").select("id", "score", "lang")


def rrf_many_lists(spark, sf):
    items, q = _items(spark, sf), _query(spark, sf)
    lists = [S.ranked(S.vector_topk(items, q, 30, where=F.col("label") % 3 == i)) for i in range(3)] + [S.ranked(S.vector_topk(items, q, 30))]
    return _round(S.fuse_rrf(lists, 15, cap=1.0))


#: Stored indexes of this process by application, tables and analyzer: the queries below share them.
_INDEXES: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf: str, analyzer: str) -> str:
    key = (spark.sparkContext.applicationId, sf, analyzer)
    if key not in _INDEXES:
        path = shared_path(spark, f"index-{analyzer}")
        I.write_index(_docs(spark, sf), path, analyzer=analyzer)
        _INDEXES[key] = path
    return _INDEXES[key]


def bm25_topk(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _round(S.top_per_query(_round(I.bm25(spark, _index(spark, sf, "plain"), asked), "score"), 5)).select("query_id", "id", "score", "rank")


def bm25_scan_topk(spark, sf):
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", F.lit("ing tion"), F.lower("n_name"), F.lit("ea ea")).alias("query"))
    return _round(S.top_per_query(_round(S.bm25(_docs(spark, sf), asked), "score"), 5)).select("query_id", "id", "score", "rank")


def fulltext_topk(spark, sf):
    return _round(I.keyword_topk(spark, _index(spark, sf, "english"), "The haing, and the EA", 20))


def fulltext_by_source(spark, sf):
    return _round(I.keyword_topk(spark, _index(spark, sf, "english"), "ea haed reing", 20, sources=["src0", "src3"]))


def fulltext_vocabulary(spark, sf):
    return I.vocabulary(spark, _index(spark, sf, "plain"))


def graph_linear(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") % 300).alias("target"))
    return _round(S.fuse_graph(S.vector_topk(_items(spark, sf), _query(spark, sf), 60), edges, 30), "semantic_score", "graph_score", "score")


def context_rank(spark, sf):
    items = _items(spark, sf).join(_docs(spark, sf), "id").withColumn("retention_score", F.when(F.col("id") % 9 > 0, F.col("id") % 9 / 9.0))
    return _round(S.context_rank(items, _query(spark, sf), 25))


def minmax_rerank(spark, sf):
    return _round(S.rerank_minmax(S.vector_topk(_items(spark, sf), _query(spark, sf), 50), 0.2, 10))


def intent_rerank(spark, sf):
    found = S.vector_topk(_items(spark, sf), _query(spark, sf), 50).join(_items(spark, sf).select("id", F.when(F.col("label") % 3 == 0, "episodic").when(F.col("label") % 3 == 1, "semantic").otherwise("fact").alias("memory_type")), "id")
    return _round(S.rerank_intent(found, "episodic", ["semantic"], 0.65))


def weight_rerank(spark, sf):
    found = S.vector_topk(_items(spark, sf), _query(spark, sf), 50).join(_items(spark, sf).select("id", (F.lit(0.5) + F.col("label") * 0.1).alias("relevance_weight")), "id")
    return _round(S.rerank_weight(found)).drop("relevance_weight")


def prf_expansion(spark, sf):
    q, items = _query(spark, sf), _items(spark, sf)
    top = S.vector_topk(items, q, 5).join(items, "id")
    out = S.expand_query(q, top)
    return out.select(F.posexplode("vector").alias("i", "v")).select("i", F.round("v", 6).alias("v"))


def hierarchical_lift(spark, sf):
    items = _items(spark, sf)
    chunks = items.select("id", F.floor(F.col("id") / 5).alias("family"), F.when(F.col("id") % 5 == 0, "parent").when(F.col("id") % 5 == 4, F.lit(None)).otherwise("child").alias("role"))
    return _round(S.lift_to_parents(S.vector_topk(items, _query(spark, sf), 40), chunks, 15)).withColumn("matched_children", F.array_join(F.col("matched_children").cast("array<string>"), ","))


def recall_ladder(spark, sf):
    docs = _docs(spark, sf)
    found = S.search_ladder([("keyword", S.keyword_topk(docs, ["zzzz", "qqqq"], 5)), ("ilike", docs.where(F.contains(F.lower("content"), F.lit("tion"))).select("id", F.lit(0.5).alias("score")).orderBy("id"))], 5)
    return found.select("id", "score", "search_level")


def multi_corpus_citations(spark, sf):
    found = S.top_per_corpus(S.vector_topk(_items(spark, sf), _query(spark, sf), 200).join(_docs(spark, sf), "id"), "source", 3)
    return _round(S.cite(found.select("id", "score", "source", F.col("lang").alias("title")), "title", "source", 20)).select("id", "score", "citation", "citation_text")


def federated_search(spark, sf):
    items, q = _items(spark, sf), _query(spark, sf)
    seeds = S.top_per_corpus(S.vector_topk(items, q, 500).join(items.select("id", "label"), "id"), "label", 20).select("id", "rank")
    graph = items.where("id % 7 = 0").select("id", F.expr("cast(id / 7 + 1 as int)").alias("rank")).orderBy("id").limit(60)
    return _round(S.federated_fusion(seeds, graph, 20))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_topk_many, cosine_columns, keyword_topk, hybrid_linear, rrf_search, rrf_many_lists, bm25_topk, bm25_scan_topk, fulltext_topk, fulltext_by_source, fulltext_vocabulary, graph_linear, context_rank, minmax_rerank, intent_rerank, weight_rerank, prf_expansion, hierarchical_lift, recall_ladder, multi_corpus_citations, federated_search)}

_BM25 = """WITH docs AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
        q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM (QUERIES)) GROUP BY ALL),
        p AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM docs) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        s AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS score FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY query_id, id)
        SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""
#: Words of a lexeme are told by their endings; the shortest spans are found from the last place of each term.
_COVERS = r"""WITH w AS (SELECT doc_id AS id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents WHERE_SOURCE)),
        l AS (SELECT id, pos, CASE WHEN regexp_full_match(word, 'ha(ed|edly|ing|ingly)?') THEN 'ha' WHEN regexp_full_match(word, 'ea(ed|edly|ing|ingly)?') THEN 'ea' WHEN regexp_full_match(word, 're(ing|ingly)?') THEN 're' END AS lexeme FROM w),
        o AS (SELECT id, pos, lexeme, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM l WHERE lexeme IN (TERMS)),
        t AS (SELECT unnest([TERMS]) AS term), e AS (SELECT o.id, o.pos, o.r, max(p.pos) AS last, max(p.r) AS last_r FROM o, t, o p WHERE p.id = o.id AND p.pos <= o.pos AND p.lexeme = t.term GROUP BY o.id, o.pos, o.r, t.term),
        s AS (SELECT id, pos, r, min(last) AS start, min(last_r) AS start_r FROM e GROUP BY id, pos, r HAVING count(*) = len([TERMS])),
        m AS (SELECT *, lag(start) OVER (PARTITION BY id ORDER BY pos) AS before FROM s), c AS (SELECT id, pos - start - (r - start_r) AS noise FROM m WHERE before IS NULL OR start > before)
        SELECT id, round(sum(0.1::DOUBLE / (1 + noise)), 6) AS score FROM c GROUP BY id ORDER BY sum(0.1::DOUBLE / (1 + noise)) DESC, id LIMIT 20"""

SQL = {
    "vector_topk": f"WITH {SEM} SELECT id, round(score, 6) AS score FROM sem_all ORDER BY sem_all.score DESC, id LIMIT 20",
    "vector_topk_filtered": f"WITH {SEM} SELECT id, round(score, 6) AS score FROM sem_all JOIN embeddings ON vec_id = id WHERE label = 3 AND score >= 0.05 ORDER BY sem_all.score DESC, id LIMIT 10",
    "vector_topk_many": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
    "cosine_columns": """SELECT a.vec_id AS a, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
        round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "keyword_topk": f"WITH {KEY} SELECT id, score FROM key_all ORDER BY score DESC, id LIMIT 20",
    "hybrid_linear": f"""WITH {SEM}, {KEY}, items AS (SELECT vec_id FROM embeddings JOIN documents ON vec_id = doc_id), s AS (SELECT * FROM sem_all WHERE id IN (FROM items) ORDER BY score DESC, id LIMIT 20), k AS (SELECT * FROM key_all WHERE id IN (FROM items) ORDER BY score DESC, id LIMIT 20),
        b AS (SELECT coalesce(s.id, k.id) AS id, coalesce(s.score, 0) AS semantic_score, coalesce(k.score, 0) AS keyword_score FROM s FULL JOIN k ON s.id = k.id)
        SELECT id, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score, round(semantic_score * 0.7::DOUBLE + keyword_score * 0.3::DOUBLE, 6) AS score FROM b ORDER BY semantic_score * 0.7::DOUBLE + keyword_score * 0.3::DOUBLE DESC, id LIMIT 10""",
    "rrf_search": f"""WITH {SEM}, {KEY}, items AS (SELECT vec_id FROM embeddings JOIN documents ON vec_id = doc_id), s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sem_all WHERE id IN (FROM items) QUALIFY rank <= 30), k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM key_all WHERE id IN (FROM items) QUALIFY rank <= 30),
        f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (FROM s UNION ALL FROM k) GROUP BY id ORDER BY score DESC, id LIMIT 10) SELECT f.id, round(f.score, 6) AS score, lang FROM f JOIN documents ON doc_id = f.id""",
    "rrf_many_lists": f"""WITH {SEM}, s AS (SELECT id, score, label % 3 AS g FROM sem_all JOIN embeddings ON vec_id = id), r AS (SELECT id, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS rank FROM s UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM s)
        SELECT id, round(least(1.0::DOUBLE, sum(1.0::DOUBLE / (60 + rank))), 6) AS score FROM r WHERE rank <= 30 GROUP BY id ORDER BY least(1.0::DOUBLE, sum(1.0::DOUBLE / (60 + rank))) DESC, id LIMIT 15""",
    "bm25_topk": _BM25.replace("QUERIES", "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "bm25_scan_topk": _BM25.replace("QUERIES", "SELECT n_nationkey AS query_id, 'ing tion ' || lower(n_name) || ' ea ea' AS query FROM nation"),
    "fulltext_topk": _COVERS.replace("TERMS", "'ha', 'ea'").replace("WHERE_SOURCE", ""),
    "fulltext_by_source": _COVERS.replace("TERMS", "'ha', 'ea', 're'").replace("WHERE_SOURCE", "WHERE source IN ('src0', 'src3')"),
    "fulltext_vocabulary": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS lexeme FROM documents) SELECT lexeme, count(DISTINCT doc_id) AS documents, count(*) AS places FROM w GROUP BY lexeme",
    "graph_linear": f"""WITH {SEM}, k AS (SELECT * FROM sem_all ORDER BY score DESC, id LIMIT 60), n AS (SELECT l_partkey % 300 AS id, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT k.id, score AS s, ln(1 + coalesce(n, 0)) / 5 AS g FROM k LEFT JOIN n ON n.id = k.id)
        SELECT id, round(s, 6) AS semantic_score, round(g, 6) AS graph_score, round(s * 0.6::DOUBLE + g * 0.4::DOUBLE, 6) AS score FROM g ORDER BY s * 0.6::DOUBLE + g * 0.4::DOUBLE DESC, id LIMIT 30""",
    "context_rank": f"""WITH {SEM} SELECT id, round(score * CASE WHEN id % 9 > 0 THEN id % 9 / 9.0::DOUBLE ELSE 0 END, 6) AS score, CAST(length(text) // 4 AS INTEGER) AS tokens FROM sem_all JOIN documents ON doc_id = id ORDER BY sem_all.score * CASE WHEN id % 9 > 0 THEN id % 9 / 9.0::DOUBLE ELSE 0 END DESC, id LIMIT 25""",
    "minmax_rerank": f"""WITH {SEM}, k AS (SELECT * FROM (SELECT * FROM sem_all ORDER BY score DESC, id LIMIT 50) WHERE score >= 0.2), b AS (SELECT min(score) AS lo, max(score) AS hi FROM k)
        SELECT id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE score END, 6) AS score FROM k, b ORDER BY k.score DESC, id LIMIT 10""",
    "intent_rerank": f"""WITH {SEM}, k AS (SELECT * FROM sem_all ORDER BY score DESC, id LIMIT 50), t AS (SELECT id, score, CASE label % 3 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' ELSE 'fact' END AS memory_type FROM k JOIN embeddings ON vec_id = id)
        SELECT id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, score * CASE memory_type WHEN 'episodic' THEN 1.15::DOUBLE WHEN 'semantic' THEN 1.03::DOUBLE ELSE 1.0::DOUBLE END)), 6) AS score, memory_type FROM t""",
    "weight_rerank": f"""WITH {SEM}, k AS (SELECT * FROM sem_all ORDER BY score DESC, id LIMIT 50) SELECT id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, score * (0.5::DOUBLE + label * 0.1::DOUBLE))), 6) AS score FROM k JOIN embeddings ON vec_id = id""",
    "prf_expansion": f"""WITH {SEM}, k AS (SELECT id FROM sem_all ORDER BY score DESC, id LIMIT 5), e AS (SELECT unnest(range(1, 65)) AS i), m AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM k JOIN embeddings ON vec_id = id, e GROUP BY i),
        x AS (SELECT i, CAST(q.embedding[i] AS DOUBLE) * 0.7::DOUBLE + mean * 0.3::DOUBLE AS x FROM m, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) SELECT CAST(i - 1 AS INTEGER) AS i, round(x / (SELECT sqrt(sum(x * x)) FROM x), 6) AS v FROM x""",
    "hierarchical_lift": f"""WITH {SEM}, h AS (SELECT id, score, id // 5 AS family, CASE id % 5 WHEN 0 THEN 'parent' WHEN 4 THEN NULL ELSE 'child' END AS role FROM (SELECT * FROM sem_all ORDER BY score DESC, id LIMIT 40)),
        l AS (SELECT family * 5 AS id, max(score) AS score, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS m FROM h WHERE role = 'child' GROUP BY family), a AS (FROM l UNION ALL SELECT id, score, '' FROM h WHERE role IS NULL OR role <> 'child')
        SELECT id, round(max(score), 6) AS score, max(m) AS matched_children FROM a GROUP BY id ORDER BY max(a.score) DESC, id LIMIT 15""",
    "recall_ladder": "SELECT doc_id AS id, 0.5::DOUBLE AS score, 'ilike' AS search_level FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 5",
    "multi_corpus_citations": f"""WITH {SEM}, k AS (SELECT id, score, source, lang FROM (SELECT * FROM sem_all ORDER BY score DESC, id LIMIT 200) JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) <= 3),
        b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS citation FROM k) SELECT id, round(score, 6) AS score, CAST(citation AS INTEGER) AS citation, '[' || citation || '] ' || lang AS citation_text FROM b WHERE citation <= 20""",
    "federated_search": f"""WITH {SEM}, k AS (SELECT id, score, label FROM (SELECT * FROM sem_all ORDER BY score DESC, id LIMIT 500) JOIN embeddings ON vec_id = id), s AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM k QUALIFY rank <= 20),
        g AS (SELECT vec_id AS id, vec_id // 7 + 1 AS rank FROM embeddings WHERE vec_id % 7 = 0 ORDER BY vec_id LIMIT 60), f AS (SELECT coalesce(s.id, g.id) AS id, coalesce(2.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + g.rank), 0) AS score FROM s FULL JOIN g ON s.id = g.id)
        SELECT id, round(score, 6) AS score FROM f ORDER BY f.score DESC, id LIMIT 20""",
}
