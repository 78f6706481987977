"""Retrieval: vector, keyword and BM25 search, fusion, reranking, feedback and hierarchical results.

Conventions: items have an id column; scores are doubles; all rankings end with the id, so ties have one order. Top-k cuts come
before any rank window, so a window never sees more than a few times k rows of one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions import text as T
from millrace.functions.columns import clamp, col

RRF_K = 60
#: Queries that a task scores a batch of items against at once.
QUERIES_AT_ONCE = 128


def vector_scores(items: DataFrame, query: list[float], id_col: str = "id", vector: str = "embedding", top: int | None = None) -> DataFrame:
    """(id, score): cosine with one query vector, 0 for unusable vectors; with ``top``, each batch passes on only its best."""
    q = np.asarray(query, float)
    qn = float(np.sqrt(q @ q))
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            score = np.zeros(batch.num_rows)
            good = np.flatnonzero(n == len(q))
            if len(good) and qn > 0:
                x = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
                norms = np.sqrt((x * x).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    score[good] = np.nan_to_num(np.where(norms > 0, (x @ q) / (norms * qn), 0.0))
            ids = batch.column(0)
            if top and len(score) > top:
                keep = np.flatnonzero(score >= np.partition(score, -top)[-top] - 1e-12)  # ties at the border stay
                ids, score = ids.take(pa.array(keep)), score[keep]
            yield pa.RecordBatch.from_arrays([ids, pa.array(score)], names=["id", "score"])

    return items.select(F.col(id_col), F.col(vector)).mapInArrow(run, f"id {kind}, score double")


def vector_topk(items: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding", where: Column | None = None, min_score: float | None = None) -> DataFrame:
    """The k items nearest to the query by cosine, best first; filters apply before scoring."""
    items = items.where(where) if where is not None else items
    scored = vector_scores(items, query, id_col, vector, top=k)
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def vector_topk_many(items: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", block: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank) for a table of queries (query_id, vector): blocks of items meet blocks of queries.

    Items are scored block by block with one matrix product; each block passes on k rows a query, merged by a rank window whose
    bound is applied before its shuffle. ``queries`` is a stated set: it is broadcast in parts of 4096 rows, so its size is bounded.
    """
    out = None
    n = queries.count()
    parts = max(1, -(-n // 4096))
    kind, qkind = items.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    for p in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else queries
        rows = mine.select("query_id", "vector").collect()
        if not rows:
            continue
        shared = items.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            q = q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                x = (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)).T
                for low in range(0, len(q), QUERIES_AT_ONCE):
                    score = q[low : low + QUERIES_AT_ONCE] @ x
                    keep = score >= np.partition(score, -k, axis=1)[:, [-k]] - 1e-12 if batch.num_rows > k else np.ones_like(score, bool)
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[low + a] for a in i.tolist()]), batch.column(0).take(pa.array(j)), pa.array(score[i, j])], names=["query_id", "id", "score"])

        usable = items.where(F.size(vector) == len(rows[0][1])).select(F.col(id_col), F.col(vector))
        found = usable.mapInArrow(run, f"query_id {qkind}, id {kind}, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return items.sparkSession.createDataFrame([], f"query_id {qkind}, id {kind}, score double, rank int")
    best = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def keyword_topk(items: DataFrame, terms: list[str], k: int, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, score) of the k items that hold every term, by how often they do."""
    terms = [t.lower() for t in terms]
    found = items.where(T.has_all_terms(text, terms))
    return found.select(F.col(id_col).alias("id"), T.term_count(text, terms).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def bm25(items: DataFrame, queries: DataFrame, id_col: str = "id", text: str = "content", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score): BM25 of every query (query_id, query) against the items that share a term.

    Postings are restricted to query terms before they are shuffled; query terms count with their multiplicity.
    """
    ascii_tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    docs = items.select(F.col(id_col).alias("id"), ascii_tokens(text).alias("tokens")).withColumn("len", F.size("tokens"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    asked = queries.select("query_id", F.explode(ascii_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("term").distinct()
    postings = docs.select("id", "len", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.col("mean")))
    joined = asked.join(df, "term").join(postings, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    return joined.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top_per_query(scores: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    best = W.Window.partitionBy(query).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked(found: DataFrame) -> DataFrame:
    """Rank from 1 of a result that a limit has already cut."""
    return found.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("score"), "id")))


def fuse_linear(semantic: DataFrame, keyword: DataFrame, k: int, semantic_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """(id, semantic_score, keyword_score, score): weighted sum over both (id, score) lists; a missing score is 0."""
    both = semantic.select("id", F.col("score").alias("semantic_score")).join(keyword.select("id", F.col("score").alias("keyword_score")), "id", "full_outer")
    both = both.fillna(0.0, ["semantic_score", "keyword_score"])
    return both.withColumn("score", F.col("semantic_score") * semantic_weight + F.col("keyword_score") * keyword_weight).orderBy(F.desc("score"), "id").limit(k)


def fuse_rrf(lists: list[DataFrame], k: int, rrf_k: int = RRF_K, cap: float | None = None) -> DataFrame:
    """(id, score): reciprocal-rank fusion of (id, rank) lists; ``cap`` bounds the score."""
    all_ = lists[0].select("id", "rank")
    for other in lists[1:]:
        all_ = all_.union(other.select("id", "rank"))
    score = F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank")))
    return all_.groupBy("id").agg((F.least(F.lit(cap), score) if cap else score).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fuse_graph(semantic: DataFrame, edges: DataFrame, k: int, semantic_weight: float = 0.6, graph_weight: float = 0.4) -> DataFrame:
    """(id, semantic_score, graph_score, score): a semantic list (id, score) with a score for how many edges (source, target) point
    to the item, ln(1 + inbound) / 5; items that nothing points to have 0. Only edges to the list's items are counted."""
    inbound = edges.join(semantic.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    both = semantic.select("id", F.col("score").alias("semantic_score")).join(inbound, "id", "left")
    both = both.withColumn("graph_score", F.log1p(F.coalesce("n", F.lit(0))) / 5.0).drop("n")
    return both.withColumn("score", F.col("semantic_score") * semantic_weight + F.col("graph_score") * graph_weight).orderBy(F.desc("score"), "id").limit(k)


def context_rank(items: DataFrame, query: list[float], k: int = 10, retention: str = "retention_score", id_col: str = "id", vector: str = "embedding", text: str = "content") -> DataFrame:
    """(id, score, tokens) of the k items whose cosine with the query times their retention is largest; tokens: a quarter of the
    characters. Null retention counts as 0."""
    scored = vector_scores(items, query, id_col, vector).join(items.select(F.col(id_col).alias("id"), F.coalesce(retention, F.lit(0.0)).alias("r"), F.floor(F.length(text) / 4).cast("int").alias("tokens")), "id")
    return scored.select("id", (F.col("score") * F.col("r")).alias("score"), "tokens").orderBy(F.desc("score"), "id").limit(k)


def hybrid_search(items: DataFrame, query: list[float], terms: list[str], k: int, id_col: str = "id", vector: str = "embedding", text: str = "content", weights: tuple[float, float] = (0.7, 0.3), recall: int = 2) -> DataFrame:
    """Weighted hybrid search; both lists hold ``recall`` times k items."""
    return fuse_linear(vector_topk(items, query, recall * k, id_col, vector), keyword_topk(items, terms, recall * k, id_col, text), k, *weights)


def rrf_search(items: DataFrame, query: list[float], terms: list[str], k: int, id_col: str = "id", vector: str = "embedding", text: str = "content", recall: int = 3, rrf_k: int = RRF_K) -> DataFrame:
    """Hybrid search by reciprocal ranks."""
    return fuse_rrf([ranked(vector_topk(items, query, recall * k, id_col, vector)), ranked(keyword_topk(items, terms, recall * k, id_col, text))], k, rrf_k)


def rerank_minmax(found: DataFrame, threshold: float = 0.0, top_k: int = 10) -> DataFrame:
    """Drop scores under the threshold, scale the rest to 0..1 if they differ, keep ``top_k``."""
    kept = found.where(F.col("score") >= threshold)
    bounds = kept.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("score"))
    return kept.crossJoin(F.broadcast(bounds)).withColumn("score", scaled).drop("low", "high").orderBy(F.desc("score"), "id").limit(top_k)


def rerank_intent(found: DataFrame, primary: str, boost_types: list[str], confidence: float, kind: str = "memory_type") -> DataFrame:
    """15 % more for the intent's type, 3 % for the next ones, unless the intent is unsure."""
    if confidence < 0.3:
        return found
    boost = F.when(col(kind) == primary, 1.15).when(col(kind).isin(boost_types), 1.03).otherwise(1.0)
    return found.withColumn("score", clamp(F.col("score") * boost)).orderBy(F.desc("score"), "id")


def rerank_weight(found: DataFrame, weight: str = "relevance_weight") -> DataFrame:
    w = F.coalesce(col(weight), F.lit(1.0))
    return found.withColumn("score", F.when(F.abs(w - 1.0) < 1e-6, F.col("score")).otherwise(clamp(F.col("score") * w))).orderBy(F.desc("score"), "id")


def expand_query(query: list[float], feedback: DataFrame, vector: str = "embedding", alpha: float = 0.7) -> DataFrame:
    """One row ``vector``: unit vector of alpha * query + (1 - alpha) * mean of the feedback vectors of the same length."""
    mean = feedback.where(F.size(vector) == len(query)).select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    given = F.element_at(F.array(*[F.lit(float(x)) for x in query]), F.col("i") + 1)
    mixed = mean.select("i", (given * alpha + F.col("mean") * (1 - alpha)).alias("x"))
    out = mixed.agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return out.select(F.transform("p", lambda e: F.when(F.col("norm") > 0, e["x"] / F.col("norm")).otherwise(e["x"])).alias("vector"))


def lift_to_parents(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Child hits become their family's parent with the best child's score and the matched children; other hits pass through.

    ``hits``: (id, score); ``chunks``: (id, family, role). Out: (id, score, matched_children).
    """
    rows = hits.join(chunks, "id", "left")
    child = rows.where("role = 'child' AND family IS NOT NULL").groupBy("family").agg(F.max("score").alias("score"), F.array_sort(F.collect_list("id")).alias("matched_children"))
    parents = chunks.where("role = 'parent'").select("family", "id")
    lifted = child.join(parents, "family").select("id", "score", "matched_children")
    none = F.array().cast(lifted.schema["matched_children"].dataType)
    passed = rows.where("role IS NULL OR role <> 'child' OR family IS NULL").select("id", "score", none.alias("matched_children"))
    return lifted.union(passed).groupBy("id").agg(F.max("score").alias("score"), F.max_by("matched_children", F.size("matched_children")).alias("matched_children")).orderBy(F.desc("score"), "id").limit(k)


def search_ladder(levels: list[tuple[str, DataFrame]], k: int) -> DataFrame:
    """First level with any result, tagged ``search_level``; levels are tried in order, one small job each."""
    for name, found in levels:
        if not found.isEmpty():
            return found.limit(k).withColumn("search_level", F.lit(name))
    return levels[-1][1].withColumn("search_level", F.lit("none"))


def cite(found: DataFrame, title: str, uri: str, cap: int = 20) -> DataFrame:
    """Best results over all corpora with citation numbers and texts."""
    best = found.orderBy(F.desc("score"), "id").limit(cap)
    best = best.withColumn("citation", F.row_number().over(W.Window.orderBy(F.desc("score"), "id")))
    arxiv = F.regexp_extract(F.coalesce(col(uri), F.lit("")), r"(\d{4}\.\d{4,5})", 1)
    label = F.when(arxiv != "", F.concat(F.lit("arXiv:"), arxiv)).otherwise(F.coalesce(col(title), col(uri), F.lit("untitled")))
    return best.withColumn("citation_text", F.concat(F.lit("["), F.col("citation"), F.lit("] "), label))


def top_per_corpus(found: DataFrame, corpus: str, k: int) -> DataFrame:
    best = W.Window.partitionBy(corpus).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def federated_fusion(seeds: DataFrame, graph: DataFrame, k: int, pool: int = 100, rrf_k: int = RRF_K) -> DataFrame:
    """Seeds (id, rank: of both channels at once) and graph expansion (id, rank) fused over three ranks; best score of each id."""
    seed = seeds.groupBy("id").agg(F.max(F.lit(2.0) / (F.lit(float(rrf_k)) + F.col("rank"))).alias("s"))
    extra = graph.groupBy("id").agg(F.max(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank"))).alias("g"))
    both = seed.join(extra, "id", "full_outer").fillna(0.0)
    return both.select("id", (F.col("s") + F.col("g")).alias("score")).orderBy(F.desc("score"), "id").limit(pool).orderBy(F.desc("score"), "id").limit(k)
