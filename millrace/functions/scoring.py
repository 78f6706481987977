"""Retention, importance and recall scores of memories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import clamp, col, days_between, lookup

# Decay a day, score multiplier and importance weight by memory type.
DECAY = {"core": 0.0, "semantic": 0.005, "preference": 0.05, "procedural": 0.06, "fact": 0.08, "episodic": 0.10}
MULTIPLIER = {"core": 1.5, "semantic": 1.4, "preference": 1.3, "procedural": 1.2, "fact": 1.15, "episodic": 1.0}
IMPORTANCE = {"core": 1.0, "semantic": 0.95, "preference": 0.9, "procedural": 0.75, "fact": 0.6, "episodic": 0.4}


def retention(days: Column, accesses: Column, decay: float = 0.1) -> Column:
    """least(1, exp(-decay * days) * (1 + ln(1 + accesses)) / 5)."""
    return F.least(F.lit(1.0), F.exp(F.lit(-float(decay)) * days) * (F.lit(1.0) + F.ln(F.lit(1.0) + accesses)) / 5)


def retention_by_type(kind: Column | str, accesses: Column | str, last_access: Column | str, created: Column | str, related: Column | str, now: Column, decay_override: Column | None = None) -> Column:
    """Decay by type (or override), frequency, type multiplier and related items, plus a bonus in the first year; 0 to 1."""
    rate = lookup(kind, DECAY, 0.10)
    if decay_override is not None:
        rate = F.coalesce(decay_override.cast("double"), rate)
    idle = F.greatest(F.lit(0.0), days_between(now, last_access))
    age = F.greatest(F.lit(0.0), days_between(now, created))
    network = F.lit(1.0) + F.least(F.lit(0.5), col(related) * 0.1)
    bonus = F.greatest(F.lit(0.0), F.lit(1.0) - age / 365.0) * 0.1
    return clamp(F.exp(-rate * idle) * (F.lit(1.0) + F.ln(F.lit(1.0) + col(accesses))) * lookup(kind, MULTIPLIER, 1.0) * network / 5.0 + bonus)


def importance(kind: Column | str, accesses: Column | str, facts: Column | str, age_days: Column, idle_days: Column) -> Column:
    """Activation, access frequency, supporting facts, type and recency, weighted .30 .25 .20 .15 .10; 0 to 1."""
    n = col(accesses)
    log_n = F.ln(F.lit(1.0) + n)
    activation = F.when(n > 0, F.least(F.lit(1.0), log_n / F.ln(F.lit(1.0) + F.sqrt(F.greatest(F.lit(1.0), idle_days + 1))))).otherwise(F.lit(0.1))
    parts = (
        activation * 0.30
        + F.least(F.lit(1.0), log_n / F.ln(F.lit(101.0))) * 0.25
        + F.least(F.lit(1.0), col(facts) / 10.0) * 0.20
        + lookup(kind, IMPORTANCE, 0.4) * 0.15
        + F.greatest(F.lit(0.0), F.lit(1.0) - age_days / 90.0) * 0.10
    )
    return clamp(parts)


def after_access(accesses: Column | str, importance_: Column | str) -> tuple[Column, Column]:
    """Access count and importance after one more access."""
    return col(accesses) + 1, F.least(F.lit(1.0), col(importance_) + 0.02)


def proximity(minutes: Column, window: float = 30.0, floor: float = 0.3) -> Column:
    """Weight of two events ``minutes`` apart."""
    return F.greatest(F.lit(floor), F.lit(1.0) - minutes / window)


def freshness(age_days: Column, full: float = 30.0, end: float = 365.0, floor: float = 0.1) -> Column:
    """1 up to ``full`` days, falling in a line to ``floor`` at ``end``."""
    return F.when(age_days <= full, F.lit(1.0)).when(age_days >= end, F.lit(floor)).otherwise(F.lit(1.0) - (age_days - full) / (end - full) * (1 - floor))


def recall_rank(importance_: Column | str, idle_days: Column, accesses: Column | str) -> Column:
    """Rank of a memory offered without a query."""
    return col(importance_) * 0.4 + F.greatest(F.lit(0.0), F.lit(1.0) - idle_days / 30.0) * 0.3 + F.least(F.lit(1.0), F.log2(F.lit(1.0) + col(accesses)) / F.log2(F.lit(101.0))) * 0.2 + 0.1


def entropy_term(share: Column) -> Column:
    return -share * F.log2(share)


def feedback_weight(helpful: Column, irrelevant: Column, votes: Column, least_votes: int = 3) -> Column:
    """Relevance weight from votes: 1 below ``least_votes``, else 1 + .75 helpful share - .15 irrelevant share, .5 to 2."""
    moved = clamp(F.lit(1.0) + F.try_divide(helpful * 0.75, votes) - F.try_divide(irrelevant * 0.15, votes), 0.5, 2.0)
    return F.when(votes < least_votes, F.lit(1.0)).otherwise(moved)


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(col(text)) / 4)
