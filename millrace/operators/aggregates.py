"""Aggregates: source summaries, memory and retrieval metrics, quality scores, timelines, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.columns import lookup, ratio
from millrace.functions.scoring import feedback_weight, freshness


def source_summary(chunks: DataFrame, uri: str, archived: Column, name: str) -> DataFrame:
    """Chunks, whether all are archived, and the first display name of each source; a null source last."""
    out = chunks.groupBy(uri).agg(F.count(F.lit(1)).alias("chunks"), F.bool_and(archived).alias("archived"), F.min(name).alias("display_name"))
    return out.orderBy(F.asc_nulls_last(uri))


def fully_archived(chunks: DataFrame, keys: list[str], archived: Column) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.bool_and(archived).alias("all_archived")).where("all_archived").select(*keys)


def retention_distribution(memories: DataFrame, score: str) -> DataFrame:
    s = F.col(score)
    return memories.agg(F.count(F.lit(1)).alias("total"), F.avg(s).alias("avg_score"), F.count_if(s >= 0.7).alias("high"), F.count_if((s >= 0.3) & (s < 0.7)).alias("medium"), F.count_if(s < 0.3).alias("low"))


def memory_metrics(memories: DataFrame, score: str, low: float = 0.3) -> DataFrame:
    """Average, 10th and 90th percentile (exact) of a score, and how many are low."""
    p = lambda q: F.expr(f"percentile_cont({q}) within group (order by {score})")
    return memories.agg(F.avg(score).alias("avg_score"), p(0.1).alias("p10"), p(0.9).alias("p90"), F.count_if(F.col(score) < low).alias("low_count"))


def retrieval_effectiveness(logs: DataFrame, ids: str, referenced: Column, feedback: str) -> DataFrame:
    """Precision (referenced share), utilisation and noise over rows with feedback, and zero-hit share."""
    given = F.count(feedback)
    return logs.agg(
        F.count(F.lit(1)).alias("total"),
        ratio(F.count_if(referenced), F.count(F.lit(1))).alias("precision"),
        ratio(F.count_if(F.col(feedback) == "helpful"), given).alias("utilization"),
        ratio(F.count_if(F.col(feedback) == "irrelevant"), given).alias("noise"),
        ratio(F.count_if(F.size(ids) == 0), F.count(F.lit(1))).alias("zero_hit"),
    )


def rocchio_weights(logs: DataFrame, ids: str, feedback: str) -> DataFrame:
    """(id, weight) of the items whose weight differs from 1."""
    votes = logs.where(F.col(feedback).isNotNull()).select(F.explode(ids).alias("id"), F.col(feedback).alias("f"))
    sums = votes.groupBy("id").agg(F.count_if(F.col("f") == "helpful").alias("h"), F.count_if(F.col("f") == "irrelevant").alias("i"), F.count(F.lit(1)).alias("n"))
    weight = feedback_weight(F.col("h"), F.col("i"), F.col("n"))
    return sums.select("id", weight.alias("weight")).where(F.abs(F.col("weight") - 1.0) >= 1e-6)


def timeline(relations: DataFrame, start: str, end: str, unit: str = "day", cap: int = 730) -> DataFrame:
    """Relations that begin and end in each bucket; the latest ``cap`` buckets, ascending."""
    begun = relations.where(F.col(start).isNotNull()).groupBy(F.date_trunc(unit, start).alias("bucket")).agg(F.count(F.lit(1)).alias("started"))
    ended = relations.where(F.col(end).isNotNull()).groupBy(F.date_trunc(unit, end).alias("bucket")).agg(F.count(F.lit(1)).alias("ended"))
    both = begun.join(ended, "bucket", "full_outer").fillna(0, ["started", "ended"])
    return both.orderBy(F.desc("bucket")).limit(cap).orderBy("bucket")


def cross_references(names: DataFrame, corpus: str, name: str, minimum: float = 0.5) -> DataFrame:
    """(a, b, shared, confidence): corpora by the share of names they have in common (Jaccard).

    Joined on the name; each name's corpora are few, and counts are aggregated before any pair is formed.
    """
    distinct = names.select(F.col(corpus).alias("c"), F.lower(name).alias("n")).distinct()
    sizes = distinct.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    pairs = distinct.alias("x").join(distinct.alias("y"), "n").where("x.c < y.c").groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    both = pairs.join(sizes.select(F.col("c").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("c").alias("b"), F.col("size").alias("sb")), "b")
    return both.withColumn("confidence", F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).where(F.col("confidence") >= minimum).select("a", "b", "shared", "confidence")


# Weights of the quality dimensions, and grades.
QUALITY_WEIGHTS = {"coverage": 0.20, "freshness": 0.15, "diversity": 0.15, "density": 0.20, "embedding_coverage": 0.15, "entity_density": 0.15}


def corpus_quality(docs: DataFrame, corpus: str, has_source: Column, age_days: Column, has_vector: Column) -> DataFrame:
    """Diversity, freshness and vector coverage of each corpus, their weighted sum (the other dimensions count 0) and the grade."""
    out = docs.groupBy(corpus).agg(F.count(F.lit(1)).alias("documents"), F.avg(has_source.cast("double")).alias("diversity"), F.avg(age_days).alias("age"), F.avg(has_vector.cast("double")).alias("embedding_coverage"))
    out = out.withColumn("freshness", freshness(F.col("age")))
    total = sum((F.col(n) * QUALITY_WEIGHTS[n] for n in ("diversity", "freshness", "embedding_coverage")), F.lit(0.0))
    out = out.withColumn("total_score", total)
    grade = F.when(F.col("documents") == 0, "empty").when(F.col("total_score") >= 0.8, "excellent").when(F.col("total_score") >= 0.6, "good").when(F.col("total_score") >= 0.4, "fair").otherwise("poor")
    return out.withColumn("grade", grade).drop("age")


def next_versions(existing: DataFrame, new: DataFrame, keys: list[str], order: str, version: str = "version") -> DataFrame:
    """New rows numbered on from the highest version of their key."""
    last = existing.groupBy(*keys).agg(F.max(version).alias("__last"))
    rank = F.row_number().over(W.Window.partitionBy(*keys).orderBy(order))
    return new.join(last, keys, "left").withColumn(version, F.coalesce("__last", F.lit(0)) + rank).drop("__last")


def facets(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def top_keys(rows: DataFrame, group: str, key: str, k: int = 3) -> DataFrame:
    """The k most frequent keys of each group as an ordered list."""
    counts = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(W.Window.partitionBy(group).orderBy(F.desc("n"), key))).where(F.col("r") <= k)
    return ranked.groupBy(group).agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda x: x[key]).alias("top"))


def latency_by_tool(calls: DataFrame, tool: str, latency: str, denied: Column) -> DataFrame:
    return calls.groupBy(tool).agg(F.count_if(~denied).alias("calls"), F.avg(F.when(~denied, F.col(latency))).alias("avg_latency"), F.count_if(denied).alias("denied"))


def suspicious_reingest(rows: DataFrame, key: str, time: str, most: int = 100) -> DataFrame:
    """Keys written in several minutes or more than ``most`` times."""
    out = rows.groupBy(key).agg(F.count_distinct(F.date_trunc("minute", time)).alias("minutes"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("minutes") > 1) | (F.col("n") > most))


def user_totals(first: DataFrame, second: DataFrame, user: str) -> DataFrame:
    """Rows of ``first`` for every user of either table, most first."""
    users = first.select(user).union(second.select(user)).distinct()
    return users.join(first.groupBy(user).agg(F.count(F.lit(1)).alias("n")), user, "left").fillna(0, ["n"]).orderBy(F.desc("n"), user)


def task_stats(runs: DataFrame, by: str, status: str, time: str, start: Column, end: Column) -> DataFrame:
    """Runs by one of the grouping columns within a time window."""
    within = runs.where((F.col(time) >= start) & (F.col(time) < end))
    ok, failed = F.count_if(F.col(status) == "success"), F.count_if(F.col(status) == "failed")
    return within.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), ok.alias("succeeded"), failed.alias("failed"), ratio(ok, ok + failed).alias("success_rate"))


def window_kpis(runs: DataFrame, status: str, latency: str, time: str, since: Column) -> DataFrame:
    recent = F.col(time) >= since
    count = lambda s: F.count_if(recent & (F.col(status) == s))
    return runs.agg(F.count(F.lit(1)).alias("total"), count("success").alias("succeeded"), count("failed").alias("failed"), ratio(count("success"), count("success") + count("failed")).alias("success_rate"), F.avg(F.when(recent, F.col(latency))).alias("avg_latency"))


def corpus_chunk_counts(corpora: DataFrame, chunks: DataFrame, corpus: str, role: str) -> DataFrame:
    """Parent chunks of each corpus, or all chunks where it has no parents; empty corpora count 0."""
    n = chunks.groupBy(corpus).agg(F.count_if(F.col(role) == "parent").alias("p"), F.count(F.lit(1)).alias("t"))
    return corpora.join(n, corpus, "left").select(corpus, F.coalesce(F.when(F.col("p") > 0, F.col("p")).otherwise(F.col("t")), F.lit(0)).alias("chunks"))


def decay_rate(memories: DataFrame, created: str, score: str, now: Column, days: int = 7) -> DataFrame:
    """By how many percent older memories' average lies under (negative: over) the average of all."""
    old = F.avg(F.when(F.col(created) < now - F.make_dt_interval(F.lit(days)), F.col(score)))
    return memories.agg(F.try_divide((old - F.avg(score)) * 100, old).alias("decay_rate"))


def type_distribution(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """Map of type counts, the commonest type, and whether another holds 30 % or more."""
    counts = rows.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(group).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by(kind, F.struct("n", kind)).alias("main_type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("types"))
    minority = F.array_max(F.filter(F.map_values("types"), lambda n: n < F.col("most")))
    return out.withColumn("conflict", F.coalesce(minority / F.col("total") >= 0.3, F.lit(False))).drop("most")


def centroid(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit-length mean vector of each group."""
    mean = vectors.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    out = mean.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return out.select(group, F.transform("p", lambda e: e["m"] / F.col("norm")).alias("centroid"))


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", item: str = "id") -> DataFrame:
    """(query, mrr, ndcg, hit, recall) at k from ranked results (query, id, rank) and relevant pairs (query, id)."""
    top = ranked.where(F.col("rank") <= k).join(relevant.select(query, item).withColumn("rel", F.lit(1)), [query, item], "left").fillna(0, ["rel"])
    total = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("total"))
    found = top.groupBy(query).agg(F.max(F.when(F.col("rel") == 1, F.lit(1.0) / F.col("rank"))).alias("rr"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum("rel").alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / F.log2(r + 1.0))
    out = total.join(found, query, "left").fillna(0.0, ["rr", "dcg"]).fillna(0, ["hits"])
    return out.select(query, F.col("rr").alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("hits") > 0).cast("int").alias("hit"), (F.col("hits") / F.col("total")).alias("recall"))


def flag_summary(rows: DataFrame, key: str, flag: str) -> DataFrame:
    counts = rows.groupBy(key, flag).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(flag, "n")))).alias("flags"))


def entropy(rows: DataFrame, by: str) -> DataFrame:
    """Shannon entropy (bits) of a column's values."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))).alias("entropy"))


def pii_rate(rows: DataFrame, flagged: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(flagged).alias("flagged"), ratio(F.count_if(flagged), F.count(F.lit(1))).alias("rate"))


def build_health(runs: DataFrame, by: str, now: Column, days: int = 30) -> DataFrame:
    """Runs of the last ``days``: their number, the share that completed (1 of none) and their mean seconds; open runs have no length."""
    recent = runs.where(F.col("started_at") >= now - F.make_dt_interval(F.lit(days)))
    done = F.count_if(F.col("status").isin("completed", "completed_with_errors"))
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return recent.groupBy(by).agg(F.count(F.lit(1)).alias("total_runs"), F.round(done / F.count(F.lit(1)), 3).alias("success_rate"), F.round(F.coalesce(F.avg(seconds), F.lit(0.0)), 1).alias("avg_duration_sec"))


def extraction_density(chunks: DataFrame, by: str, entities: Column, length: Column, share: float = 0.95) -> DataFrame:
    """Counters of a build, and entities for each 1000 characters of a chunk at the quantile ``share``."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum(entities).alias("entities"), F.percentile(entities / F.nullif(length, F.lit(0)) * 1000, F.lit(share)).alias("density_p95"))


#: Entity types by rank, and the shares at which a type contests the main one or, if of higher rank, replaces it.
TYPE_RANK = {"person": 10, "organization": 9, "location": 8, "event": 7, "product": 6, "concept": 5, "document": 4, "other": 1}
CONTEST_SHARE, UPGRADE_SHARE, STOPWORD_SHARE = 0.30, 0.15, 0.5


def canonical_aggregates(mentions: DataFrame, corpora: int, last_aliases: int = 32) -> DataFrame:
    """One row for each ``canonical`` entity of the mentions (canonical, corpus, name, type, n, vector, seq, review), in one pass each.

    ``corpus_count`` and ``total`` (sum of ``n``, null: 1); ``types``, mentions by lower-cased type (null: other); ``main_type``, that
    of the first mention by ``seq``, unless a type of higher rank holds UPGRADE_SHARE; ``under_review``, if another type than the
    first holds CONTEST_SHARE (then nothing is replaced); ``aliases``, the last ``last_aliases`` mentions in order; ``centroid``, the
    unit vector of the mean over vectors of the entity's commonest length; ``stopword_like``, in STOPWORD_SHARE of all ``corpora``
    or more, if there are four at least. Everything is a sum, a count or a bounded list, so partial results merge in any order.
    """
    rows = mentions.withColumn("type", F.lower(F.coalesce("type", F.lit("other")))).withColumn("n", F.coalesce(F.col("n"), F.lit(1)))
    by_type = rows.groupBy("canonical", "type").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("n"), F.min(F.struct("seq", "type")).alias("first"))
    rank = lookup(F.col("type"), TYPE_RANK, 0.0)
    types = by_type.groupBy("canonical").agg(F.sort_array(F.collect_list(F.struct("type", "held"))).alias("types"), F.sum("held").alias("held"), F.sum("n").alias("total"), F.min("first").alias("first"), F.max(F.struct(rank.alias("rank"), "held", F.col("type").alias("type"))).alias("top"))
    first = F.col("first.type")
    contested = F.exists("types", lambda t: (t["type"] != first) & (t["held"] >= F.col("held") * CONTEST_SHARE))
    higher = (F.col("top.rank") > lookup(first, TYPE_RANK, 0.0)) & (F.col("top.held") >= F.col("held") * UPGRADE_SHARE)
    types = types.select("canonical", "total", "types", F.when(~contested & higher, F.col("top.type")).otherwise(first).alias("main_type"), contested.alias("under_review"))
    wide = rows.groupBy("canonical", "corpus").agg(F.lit(1).alias("one")).groupBy("canonical").agg(F.count("corpus").alias("corpus_count"))
    latest = W.Window.partitionBy("canonical").orderBy(F.desc("seq"), F.desc("name"))
    alias = F.struct("seq", "name", "corpus", F.when(F.col("review"), 0.7).otherwise(1.0).alias("score"))
    aliases = rows.withColumn("__r", F.row_number().over(latest)).where(F.col("__r") <= last_aliases).groupBy("canonical").agg(F.sort_array(F.collect_list(alias)).alias("aliases"))
    sums = rows.where(F.size("vector") > 0).select("canonical", F.size("vector").alias("d"), F.posexplode("vector").alias("i", "x")).groupBy("canonical", "d", "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("rows"))
    vectors = sums.groupBy("canonical", "d").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("sum"), F.max("rows").alias("rows"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    vectors = vectors.groupBy("canonical").agg(F.max_by(F.struct("sum", "norm"), F.struct("rows", "d")).alias("v"))
    centroid = F.transform("v.sum", lambda e: F.when(F.col("v.norm") > 0, e["x"] / F.col("v.norm")).otherwise(e["x"]))
    out = types.join(wide, "canonical").join(aliases, "canonical").join(vectors.select("canonical", centroid.alias("centroid")), "canonical", "left")
    common = F.lit(corpora >= 4) & (F.col("corpus_count") >= corpora * STOPWORD_SHARE)
    return out.withColumn("stopword_like", common)
