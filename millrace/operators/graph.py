"""Graph operators over two tables: vertices (id, ...) and edges (source, target, ...).

Walks are breadth-first: a frontier joins the edges and is cleared of what was visited, so a level costs one join however many
paths lead to a vertex. Each level or iteration is a table in the shared folder, so lineage stays short and a lost executor costs
no earlier level. Ids may be strings or numbers; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.columns import ratio
from millrace.functions.predicates import valid_at
from millrace.operators.components import component_labels
from millrace.operators.joins import incident_counts, with_both_ends
from millrace.operators.search import vector_topk_many
from millrace.plans.materialize import broadcast_if_small, bucketed, free, materialize, shuffle_parts

#: Links of a bucket: more links need more buckets, not more memory of a task.
LINKS = 4_000_000


def link_parts(links: DataFrame) -> int:
    """Buckets of a table of links."""
    return max(shuffle_parts(links.sparkSession), -(-links.count() // LINKS))


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Edges in both directions as (src, dst, ...), without loops."""
    forward = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), *extra)
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), *extra)
    return forward.union(back).where("src <> dst")


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int, at: Column | None = None) -> DataFrame:
    """(id, distance) of all vertices up to ``depth`` undirected steps from the seeds (id), seeds at 0; edges valid ``at`` a time."""
    if at is not None:
        edges = edges.where(valid_at("valid_from", "valid_to", at))
    links = materialize(both_ways(edges).distinct())
    seen = materialize(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen, "id", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = materialize(seen.union(frontier))
    return seen


def one_hop(edges: DataFrame, vertex, limit: int = 50) -> DataFrame:
    """Edges at a vertex as (id of the other end, direction, weight), heaviest first, without loops."""
    out = edges.where(F.col("source") == vertex).select(F.col("target").alias("id"), F.lit("out").alias("direction"), "weight")
    in_ = edges.where(F.col("target") == vertex).select(F.col("source").alias("id"), F.lit("in").alias("direction"), "weight")
    return out.union(in_).where(F.col("id") != vertex).orderBy(F.desc("weight"), "id", "direction").limit(limit)


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, distance, path): one shortest undirected path from the nearest seed; of several, the one of least predecessors."""
    links = materialize(both_ways(edges).distinct())
    seen = materialize(seeds.select("id").distinct().select("id", F.lit(0).alias("distance"), F.array("id").alias("path")))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("src"), "path").join(links, "src").select(F.col("dst").alias("id"), "path")
        best = step.groupBy("id").agg(F.min("path").alias("path"))  # arrays compare by element
        frontier = materialize(best.join(seen, "id", "left_anti").select("id", F.lit(d).alias("distance"), F.array_append("path", F.col("id")).alias("path")))
        if frontier.isEmpty():
            break
        seen = materialize(seen.union(frontier))
    return seen


def evidence_chains(edges: DataFrame, seeds: DataFrame, targets: DataFrame, depth: int = 4) -> DataFrame:
    """(target, hop, source, dest, weight, type): the heaviest edge of each step on the path to each target."""
    paths = shortest_paths(edges, seeds, depth).join(targets.select("id"), "id", "left_semi").where("distance > 0")
    hops = paths.select(F.col("id").alias("target_id"), F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("hop", "p")).select("target_id", "hop", "p.a", "p.b")
    both = both_ways(edges, "weight", "type").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.max(F.struct("weight", "type")).alias("w"))
    return hops.join(both, ["a", "b"]).select("target_id", "hop", F.col("a").alias("source"), F.col("b").alias("dest"), "w.weight", "w.type")


def subgraph(vertices: DataFrame, edges: DataFrame, center, radius: int, limit: int, importance: str) -> tuple[DataFrame, DataFrame]:
    """Vertices near a centre, by distance and then importance, and the edges among them."""
    spark = vertices.sparkSession
    seed = spark.createDataFrame([(center,)], f"id {vertices.schema['id'].dataType.simpleString()}")
    near = neighbours(edges, seed, radius).join(vertices, "id").orderBy("distance", F.desc(importance), "id").limit(limit)
    near = materialize(near)
    return near, with_both_ends(edges, near)


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): weighted PageRank of directed edges (source, target, weight); parallel edges add up.

    Mass of vertices without outgoing edges, and teleports, go to all vertices or, if given, to the seeds (personalised). Stops
    when the scores move by less than vertices * tolerance in sum. No valid seed gives an empty result.
    """
    # dealt once by source: sums, shares and all iterations find them there
    parts = link_parts(edges)
    weights = edges.select("source", "target", "weight").repartition(parts, "source").groupBy("source", "target").agg(F.sum(F.col("weight").cast("double")).alias("w")).where("w > 0")
    total = F.sum("w").over(W.Window.partitionBy("source"))
    share = bucketed(weights.select("source", "target", (F.col("w") / total).alias("share")), "source", parts)
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    if seeds is not None:
        marks = seeds.select("id").distinct().withColumn("p", F.lit(1.0))
        ids = ids.join(marks, "id", "left").fillna(0.0, ["p"])
    else:
        ids = ids.withColumn("p", F.lit(1.0))
    ids = materialize(ids)
    total = ids.agg(F.sum("p").alias("all"), F.count(F.lit(1)).alias("n")).first()
    spark = edges.sparkSession
    if not total["n"] or not total["all"]:
        return spark.createDataFrame([], f"id {edges.schema['source'].dataType.simpleString()}, score double")
    n = total["n"]
    ends = share.select(F.col("source").alias("id")).distinct().withColumn("has_out", F.lit(True))
    base = materialize(ids.join(ends, "id", "left").select("id", (F.col("p") / total["all"]).alias("p"), F.coalesce("has_out", F.lit(False)).alias("has_out")))
    ranks = base.select("id", "p", "has_out", F.lit(1.0 / n).alias("score"))
    for _ in range(iterations):
        dangling = ranks.where("not has_out").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        moved = share.join(ranks.select(F.col("id").alias("source"), "score").hint("shuffle_hash"), "source").groupBy(F.col("target").alias("to")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        step = ranks.join(moved, ranks["id"] == moved["to"], "left").crossJoin(F.broadcast(dangling))  # one row
        new = F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p")) + F.lit(1 - alpha) * F.col("p")
        done, ranks = ranks, materialize(step.select("id", "p", "has_out", new.alias("score"), F.abs(new - F.col("score")).alias("moved")))
        free(done)
        if (ranks.agg(F.sum("moved")).first()[0] or 0.0) < n * tolerance:
            break
    return ranks.select("id", "score")


def decay_expansion(edges: DataFrame, seeds: DataFrame, depth: int = 2, alpha: float = 0.5, k: int = 20) -> DataFrame:
    """(id, score) spread from seeds (id): a new vertex gains alpha ** level times its heaviest edge from the level before; top k,
    scaled to 1. Visited vertices gain nothing more."""
    links = both_ways(edges, "weight")  # the heaviest of parallel edges is told with the heaviest of all
    seen = materialize(seeds.select("id").distinct().withColumn("score", F.lit(1.0)))
    frontier = seen
    for d in range(1, min(depth, 5) + 1):
        gain = links.join(broadcast_if_small(frontier.select(F.col("id").alias("src"))), "src").groupBy(F.col("dst").alias("id")).agg((F.lit(alpha**d) * F.max("weight")).alias("score"))
        frontier = materialize(gain.join(broadcast_if_small(seen), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = materialize(seen.union(frontier))
    top = seen.agg(F.max("score").alias("top"))
    return seen.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.col("top")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def spread_to_items(scores: DataFrame, mentions: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, score): sum of entity score times mention weight over (entity_id, item, weight)."""
    return scores.withColumnRenamed("id", "entity_id").join(mentions, "entity_id").groupBy(item).agg(F.sum(F.col("score") * F.col("weight")).alias("score"))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 10) -> DataFrame:
    """(id, community) by local moves of greatest modularity gain, in rounds where only one half of the vertices may move.

    Deterministic: halves by hash, ties to the smaller community. Exact labels differ from other heuristics; compare modularity.
    """
    links = both_ways(edges, "weight")
    parts = link_parts(links)
    links = bucketed(links.repartition(parts, "dst").groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("w")), "dst", parts)
    strength = materialize(links.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("k")))
    m2 = strength.agg(F.sum("k")).first()[0]
    labels = materialize(strength.select("id", "k", F.col("id").alias("community")))
    if not m2:
        return labels.select("id", "community")
    for r in range(rounds):
        sizes = labels.groupBy("community").agg(F.sum("k").alias("total"))
        named = materialize(labels.join(sizes, "community"))
        # links stay in their buckets, those of the half that may move travel once, to their vertex
        turn = lambda c: F.pmod(F.xxhash64(c), F.lit(2)) == r % 2  # noqa: B023, E731
        there = named.select(F.col("id").alias("dst"), "community", "total").hint("shuffle_hash")
        near = links.where(turn("src")).join(there, "dst").select(F.col("src").alias("id"), "community", "total", "w").repartition(parts, "id")
        own = named.where(turn("id")).select("id", "k", F.col("community").alias("old")).hint("shuffle_hash")
        gain = near.groupBy("id", "community", "total").agg(F.sum("w").alias("to")).join(own, "id")
        total = F.col("total") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)
        gain = gain.withColumn("gain", F.col("to") - F.lit(resolution / m2) * F.col("k") * total)
        best = gain.groupBy("id").agg(F.max(F.struct("gain", "community")).alias("g"), F.max(F.when(F.col("community") == F.col("old"), F.col("gain"))).alias("stay"))
        moves = best.where(F.col("g.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12).select("id", F.col("g.community").alias("new"))
        updated = materialize(labels.join(moves, "id", "left").select("id", "k", F.coalesce("new", "community").alias("community"), F.col("new").isNotNull().alias("moved")))
        changed = updated.where("moved").limit(1).count()
        free(named)
        labels = updated.drop("moved")
        if not changed and r % 2:
            break
    return labels.select("id", "community")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a partition (id, community)."""
    links = both_ways(edges, "weight").join(labels.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    inside = links.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("i"), F.sum("weight").alias("m2"))
    sizes = links.groupBy("a").agg(F.sum("weight").alias("k"))
    squares = sizes.agg(F.sum(F.col("k") * F.col("k")).alias("s"))
    return inside.crossJoin(squares).select((F.col("i") / F.col("m2") - F.lit(resolution) * F.col("s") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def weak_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id connected; isolated vertices are their own."""
    labels = component_labels(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return vertices.select("id").join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("component"))


def statistics(vertices: DataFrame, edges: DataFrame, kind: str = "kind") -> DataFrame:
    """One row: counts, density, isolated share, average degree and entropy of the vertex types."""
    v = incident_counts(vertices, edges)
    counts = v.agg(F.count(F.lit(1)).alias("vertices"), ratio(F.count_if(F.col("degree") == 0), F.count(F.lit(1))).alias("isolated_ratio"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("confidence").alias("avg_confidence"))
    kinds = vertices.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    total = kinds.agg(F.sum("n").alias("t"))
    h = kinds.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))).alias("entropy"))
    row = counts.crossJoin(e).crossJoin(h)  # one row each
    density = F.round(ratio(F.col("edges"), F.col("vertices") * (F.col("vertices") - 1)), 4)
    return row.select("*", density.alias("density"), ratio(F.col("edges") * 2, F.col("vertices")).alias("avg_degree"))


def health_score(stats: DataFrame, build_success_rate: Column) -> DataFrame:
    """0 to 100: coverage 25, isolation 20, density 10, type balance 15, confidence 15, builds 15; cut to a whole number."""
    capped = lambda c, full, points: F.least(c / full, F.lit(1.0)) * points
    score = (
        capped(F.col("vertices"), 100, 25)
        + F.greatest(F.lit(0.0), F.lit(1.0) - F.col("isolated_ratio") / 0.4) * 20
        + capped(F.col("density"), 0.005, 10)
        + capped(F.col("entropy"), 1.5, 15)
        + capped(F.col("avg_confidence"), 0.8, 15)
        + capped(build_success_rate, 0.95, 15)
    )
    return stats.withColumn("health", score.cast("int"))


def quality(vertices: DataFrame, edges: DataFrame, mentions: DataFrame, documents: DataFrame, evidence: Column) -> DataFrame:
    """Dangling edges, orphans, coverage, confidence and evidence, and .4 integrity + .2 of each of the rest."""
    ids = vertices.select("id")
    ends = edges.withColumn("eid", F.monotonically_increasing_id()).select("eid", F.explode(F.array("source", "target")).alias("id"))
    dangling = ends.join(ids, "id", "left_anti").select("eid").distinct().agg(F.count(F.lit(1)).alias("dangling"))
    orphans = ids.join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    cover = documents.select("doc_id").distinct().join(mentions.select("doc_id").distinct().withColumn("m", F.lit(1)), "doc_id", "left").agg(F.avg(F.coalesce("m", F.lit(0)).cast("double")).alias("coverage"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("confidence").alias("confidence"), F.avg(evidence.cast("double")).alias("evidence"))
    row = dangling.crossJoin(orphans).crossJoin(cover).crossJoin(e).crossJoin(ids.agg(F.count(F.lit(1)).alias("vertices")))
    integrity = F.lit(1.0) - ratio(F.col("dangling") + F.col("orphans"), F.col("edges") + F.col("vertices"))
    parts = integrity * 0.4 + (F.col("coverage") + F.col("confidence") + F.col("evidence")) * 0.2
    return row.select("dangling", "orphans", "coverage", "confidence", "evidence", F.round(parts, 4).alias("quality"))


def resolve_temporal(existing: DataFrame, new: DataFrame, exclusive: list[str]) -> DataFrame:
    """Verdict of each new relation against the active ones: reinforce, update, contradict or new.

    Same ends and type with the same evidence reinforce, with other evidence update (the old one expires); for an exclusive type
    another target contradicts (the old ones expire).
    """
    same = existing.select("source", "target", "type", F.col("evidence").alias("old_evidence"), F.lit(True).alias("known"))
    others = existing.where(F.col("type").isin(exclusive)).groupBy("source", "type").agg(F.collect_set("target").alias("targets"))
    both = new.join(same, ["source", "target", "type"], "left").join(others, ["source", "type"], "left")
    contradicts = F.size(F.array_remove(F.coalesce("targets", F.array().cast(others.schema["targets"].dataType)), F.col("target"))) > 0
    verdict = F.when(F.col("known") & F.col("evidence").eqNullSafe(F.col("old_evidence")), "reinforce").when(F.col("known"), "update").when(contradicts, "contradict").otherwise("new")
    return both.select("source", "target", "type", "evidence", verdict.alias("verdict"))


def expire(edges: DataFrame, ids: DataFrame, id_col: str, at: Column) -> DataFrame:
    """Set ``valid_to`` of the edges in ``ids``."""
    marked = ids.select(id_col).distinct().withColumn("__x", F.lit(True))
    return edges.join(marked, id_col, "left").withColumn("valid_to", F.when(F.col("__x"), at).otherwise(F.col("valid_to"))).drop("__x")


def rewrite_endpoints(edges: DataFrame, id_map: DataFrame, kept: DataFrame) -> DataFrame:
    """Endpoints by a merge map (old, new); edges to unknown vertices and loops go; parallel edges add up."""
    id_map = broadcast_if_small(id_map)
    for end in ("source", "target"):
        m = id_map.select(F.col("old").alias(end), F.col("new").alias("__new"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    edges = with_both_ends(edges.where("source <> target"), kept)
    return edges.groupBy("source", "target", "type").agg(F.sum("weight").alias("weight"))


def merge_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities after merges (old, new): aliases united, mentions summed, highest confidence, merged ones gone."""
    mapped = entities.join(merges.select(F.col("old").alias("id"), "new"), "id", "left").withColumn("to", F.coalesce("new", "id"))
    alias = F.when(F.col("to") != F.col("id"), F.col("name"))
    return mapped.groupBy(F.col("to").alias("id")).agg(F.max(F.when(F.col("to") == F.col("id"), F.col("name"))).alias("name"), F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(alias)).alias("aliases"))


def sync_entities(mentions: DataFrame, name: str = "name", confidence: str = "confidence") -> DataFrame:
    """One entity a canonical name (trimmed, lower case): best confidence and its name, mentions."""
    canonical = F.lower(F.trim(F.col(name)))
    return mentions.groupBy(canonical.alias("canonical")).agg(F.max_by(name, F.struct(confidence, name)).alias("name"), F.max(confidence).alias("confidence"), F.count(F.lit(1)).alias("mentions"))


def context_triples(edges: DataFrame, seeds: DataFrame, budget: int, per_seed: int = 5, tokens: int = 30) -> DataFrame:
    """Each seed's heaviest edges as text lines, as many as fit a token budget."""
    links = both_ways(edges, "weight", "type").join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    ranked = links.withColumn("r", F.row_number().over(W.Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "type"))).where(F.col("r") <= per_seed)
    lines = ranked.orderBy("src", "r").limit(max(0, budget - 200) // tokens)
    return lines.select("src", "r", F.concat_ws(" ", F.lit("-"), F.col("src").cast("string"), F.concat(F.lit("["), F.col("type"), F.lit("]")), F.col("dst").cast("string")).alias("line"))


def publication_slice(mentions: DataFrame, published: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities mentioned in published documents by mentions, the edges among them, and whether there were more than ``limit``."""
    counts = mentions.join(published, "doc_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    top = materialize(counts.orderBy(F.desc("mentions"), "id").limit(limit + 1).withColumn("r", F.row_number().over(W.Window.orderBy(F.desc("mentions"), "id"))))
    kept = top.where(F.col("r") <= limit).drop("r")
    return kept, with_both_ends(edges, kept), top.agg((F.count(F.lit(1)) > limit).alias("truncated"))


def community_summaries(members: DataFrame, size: int = 5) -> DataFrame:
    """(community, n, summary): names of the most important members, in place of a written summary."""
    ranked = members.withColumn("r", F.row_number().over(W.Window.partitionBy("community").orderBy(F.desc("importance"), "name")))
    out = ranked.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= size, F.struct("r", "name")))).alias("top"))
    names = F.array_join(F.transform("top", lambda x: x["name"]), ", ")
    return out.select("community", "n", F.concat(F.lit("Community of "), F.col("n"), F.lit(" related entities: "), names).alias("summary"))


def hits_to_works(hits: DataFrame, uri: str) -> DataFrame:
    """Best hit of each work (arXiv id, else URI), ranked. Ranges of the score are ranked apart and moved by the number before them."""
    arxiv = F.regexp_extract(uri, r"(\d{4}\.\d{4,5})", 1)
    best = hits.groupBy(F.coalesce(F.nullif(arxiv, F.lit("")), F.col(uri)).alias("work")).agg(F.max("score").alias("score"), F.max_by("id", F.struct("score", "id")).alias("id"))
    parts = materialize(best.repartitionByRange(F.desc("score"), "work").withColumn("part", F.spark_partition_id()))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a partition
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = parts.withColumn("r", F.row_number().over(W.Window.partitionBy("part").orderBy(F.desc("score"), "work")))
    return ranked.join(F.broadcast(starts), "part").select("work", "score", "id", (F.col("start") + F.col("r")).cast("int").alias("rank"))


def multi_hop(edges: DataFrame, vertices: DataFrame, query: str, k: int = 10, depth: int = 3, iterations: int = 20) -> DataFrame:
    """(id, score, path): personalised PageRank from the vertices named in the query, without them, each with a path to a seed."""
    lower = F.lit(query.lower())
    seeds = materialize(vertices.where(F.contains(lower, F.lower("name")) & (F.length("name") > 2)).select("id"))
    scores = pagerank(edges, seeds, iterations=iterations).join(seeds, "id", "left_anti").orderBy(F.desc("score"), "id").limit(k)
    return scores.join(shortest_paths(edges, seeds, depth).select("id", "path"), "id", "left")


def tree(nodes: DataFrame, root_parent: Column, max_depth: int = 20) -> DataFrame:
    """(id, depth, path) of an adjacency list (id, parent, name, position), roots at depth 0; one join a level."""
    level = nodes.where(root_parent).select("id", F.lit(0).alias("depth"), F.array("name").alias("path"))
    out = level = materialize(level)
    for d in range(1, max_depth + 1):
        level = materialize(nodes.join(level.select(F.col("id").alias("parent"), F.col("path").alias("up")), "parent").select("id", F.lit(d).alias("depth"), F.array_append("up", F.col("name")).alias("path")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def navigation(entries: DataFrame, path: str) -> DataFrame:
    """All containers of entries' paths (array of slugs), with those that have no entry of their own marked ``synthetic``."""
    prefixes = entries.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i))).alias("path"))
    counts = prefixes.groupBy("path").agg(F.count(F.lit(1)).alias("entries"))
    own = entries.select(F.col(path).alias("path")).distinct().withColumn("own", F.lit(True))
    return counts.join(own, "path", "left").select("path", F.size("path").alias("depth"), "entries", F.col("own").isNull().alias("synthetic"))


def link_seeds(queries: DataFrame, entities: DataFrame, threshold: float, k: int = 5, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score): up to ``k`` entities nearest to each query (query_id, vector) at a similarity of ``threshold`` or more."""
    return vector_topk_many(entities, queries, k, id_col, vector).where(F.col("score") >= threshold).select("query_id", "id", "score")


def association_hops(edges: DataFrame, seeds: DataFrame, hops: int = 3, min_weight: float = 0.6, types: tuple[str, ...] = ("semantic", "temporal")) -> DataFrame:
    """(id, distance) of what the seeds reach over edges of these types and of ``min_weight`` or more, without the seeds."""
    strong = edges.where(F.col("type").isin(*types) & (F.col("weight") >= min_weight))
    return neighbours(strong, seeds, hops).where("distance > 0")
