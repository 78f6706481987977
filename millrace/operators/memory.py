"""Memory lifecycle: retention sweeps, conflicts, near-duplicate merging, topic clusters, audits, context assembly, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.columns import days_between
from millrace.functions.scoring import retention
from millrace.operators.components import component_labels
from millrace.operators.joins import nearest_above, stars_under
from millrace.operators.windows import failure_streak, no_progress, oscillating, within_budget


def sweep(memories: DataFrame, now: Column, threshold: float = 0.1, least_days: float = 30.0, decay: float = 0.1) -> DataFrame:
    """Recomputed retention and whether a row would go: below the threshold and older than ``least_days``. Nothing is deleted."""
    idle = F.greatest(F.lit(0.0), days_between(now, "last_accessed_at"))
    score = retention(idle, F.col("access_count"), decay)
    return memories.withColumn("retention_score", score).withColumn("expired", (F.col("retention_score") < threshold) & (days_between(now, "created_at") > least_days))


def due_threads(threads: DataFrame, jobs: DataFrame, thread: str, now: Column, hours: int) -> DataFrame:
    """Active threads without a job in the last ``hours``."""
    recent = jobs.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))).select(thread).distinct()
    return threads.where("active").join(recent, thread, "left_anti")


def merge_near(memories: DataFrame, block: str, id_col: str, vector: str, retention_col: str, max_distance: float = 0.10, keep_history: int = 5) -> DataFrame:
    """(loser, winner, distance): each memory with a near one of higher retention (ties: smaller id) goes to the nearest such one.

    Defined by pairs, so the result has no processing order. ``keep_history`` bounds the provenance the caller stores.
    """
    moves = nearest_above(memories, block, id_col, vector, retention_col, max_distance)
    return moves.select(F.col("a").alias("loser"), F.col("b").alias("winner"), "distance")


def topic_clusters(memories: DataFrame, block: str, id_col: str, vector: str, eps: float = 0.15) -> DataFrame:
    """(id, cluster) of memories connected by distances of ``eps`` or less; singletons are left out."""
    labels = component_labels(stars_under(memories, block, id_col, vector, eps))
    return labels.select(F.col("node").alias("id"), F.col("label").alias("cluster"))


def fact_conflicts(facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each fact with its predecessor of the same key: new, same, refined (more confident), contradicted."""
    w = W.Window.partitionBy(*keys).orderBy(order)
    old, sure = F.lag("value").over(w), F.lag("confidence").over(w)
    status = F.when(old.isNull(), "new").when(old == F.col("value"), F.when(F.col("confidence") > sure, "refined").otherwise("same")).otherwise(F.when(F.col("confidence") >= sure, "superseded").otherwise("contradicted"))
    return facts.withColumn("status", status)


def audit(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of decisions (memory_id, decision, expected_version, idempotency_key): the first of a key counts, versions must match.

    retain leaves, delete removes, anonymize blanks the content; a repeated key is a replay, another version a conflict.
    """
    first = W.Window.partitionBy("idempotency_key").orderBy("seq")
    d = decisions.withColumn("n", F.row_number().over(first))
    both = d.join(memories.select("memory_id", "version"), "memory_id", "left")
    outcome = F.when(F.col("n") > 1, "replayed").when(F.col("version").isNull(), "missing").when(F.col("expected_version") != F.col("version"), "conflict").otherwise("applied")
    return both.select("seq", "memory_id", "decision", outcome.alias("outcome"), (F.coalesce("version", F.lit(0)) + F.when(outcome == "applied", 1).otherwise(0)).alias("version"))


def apply_audit(memories: DataFrame, outcomes: DataFrame) -> DataFrame:
    done = outcomes.where("outcome = 'applied'").groupBy("memory_id").agg(F.max_by("decision", "seq").alias("decision"))
    both = memories.join(done, "memory_id", "left").where(~F.col("decision").eqNullSafe("delete"))
    return both.withColumn("content", F.when(F.col("decision") == "anonymize", "[anonymized]").otherwise(F.col("content"))).drop("decision")


def new_reflections(candidates: DataFrame, existing: DataFrame, user: str, digest: str, time: str, daily: int = 10, days: int = 7) -> DataFrame:
    """Candidates whose hash is not among the user's of the last days, within a daily limit."""
    c = candidates.withColumn("__day", F.to_date(time))
    old = existing.select(F.col(user).alias("__u"), F.col(digest).alias("__d"), F.col(time).alias("__t"))
    seen = (F.col(user) == F.col("__u")) & (F.col(digest) == F.col("__d")) & (F.col("__t") < F.col(time)) & (F.col("__t") >= F.col(time) - F.make_dt_interval(F.lit(days)))
    fresh = c.join(old, seen, "left_anti")
    fresh = fresh.withColumn("__n", F.row_number().over(W.Window.partitionBy(user, digest, "__day").orderBy(time))).where("__n = 1")
    rank = F.row_number().over(W.Window.partitionBy(user, "__day").orderBy(time, digest))
    return fresh.withColumn("__n", rank).where(F.col("__n") <= daily).drop("__n", "__day")


def context_window(memories: DataFrame, history: DataFrame, user: str, budget: int, memory_share: float = 0.3, history_share: float = 0.5) -> DataFrame:
    """Memories by relevance x retention and the latest history (user, id, content, rank_score), each within its token share."""
    part = lambda rows, share, kind: within_budget(rows.withColumn("tokens", F.floor(F.length("content") / 4)), user, [F.desc("rank_score"), F.col("id")], "tokens", int(budget * share)).select(user, F.lit(kind).alias("part"), "id", "tokens", "used")
    return part(memories, memory_share, "memory").union(part(history, history_share, "history"))


def decide(iterations: DataFrame, routine: str, order: str, target: float, most: int, patience: int = 3, most_failures: int = 3) -> DataFrame:
    """(routine, decision): success, unrecoverable, budget, no_progress, oscillation or continue, in this order."""
    ok = iterations.groupBy(routine).agg(F.max(F.coalesce(F.col("score") >= target, F.lit(False))).alias("success"), F.count(F.lit(1)).alias("n"))
    fails = failure_streak(iterations, routine, order, F.col("exec_status") == "failed", F.col("exec_status") == "healed")
    stalled, swings = no_progress(iterations, routine, order, "score", patience), oscillating(iterations, routine, order, "score", "verdict")
    both = ok.join(fails, routine, "left").join(stalled, routine, "left").join(swings, routine, "left")
    decision = F.when(F.col("success"), "success").when(F.col("streak") >= most_failures, "unrecoverable").when(F.col("n") >= most, "budget").when(F.col("stalled"), "no_progress").when(F.col("oscillating"), "oscillation").otherwise("continue")
    return both.select(routine, decision.alias("decision"))


def stale_runs(runs: DataFrame, now: Column, minutes: float) -> DataFrame:
    stale = (F.col("status") == "running") & ((F.unix_micros(now) - F.unix_micros("started_at")) / 60_000_000.0 > minutes)
    return runs.withColumn("status", F.when(stale, "timed_out").otherwise(F.col("status")))


def next_fire(tasks: DataFrame) -> DataFrame:
    """Next time of interval tasks; one-shot tasks fire once."""
    later = F.col("last_fire") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("interval_seconds").cast("decimal(18,6)"))
    return tasks.withColumn("next_fire", F.when(F.col("kind") == "interval", later).when(F.col("last_fire").isNull(), F.col("start_at")))


def core_block(blocks: DataFrame, key: list[str], budget: int) -> DataFrame:
    """Lines of each block that fit a character budget, and the next version."""
    lines = blocks.select(*key, "version", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    kept = within_budget(lines.withColumn("size", F.length("line") + 1), key[0], [F.col("i")], "size", budget)
    return kept.groupBy(*key, "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("content")).withColumn("version", F.col("version") + 1)


def merge_similar_facts(facts: DataFrame, kind: str, id_col: str, vector: str, confidence: str, similarity: float = 0.85) -> DataFrame:
    """(loser, winner): facts that go, as one of their type at that similarity is more confident (ties: smaller id); the most confident of these is named.

    The result doesn't depend on the order of facts: each is held against all others of its type, those that go included.
    """
    gone = nearest_above(facts, kind, id_col, vector, confidence, 1 - similarity, highest=True)
    return gone.select(F.col("a").alias("loser"), F.col("b").alias("winner"))
