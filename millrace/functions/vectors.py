"""Vector column functions. All arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 for empty vectors, different lengths, a zero norm or null."""
    a, b = col(a), col(b)
    sizes = (F.size(a) > 0) & (F.size(a) == F.size(b))
    norms = norm(a) * norm(b)
    return F.when(sizes & (norms > 0), F.try_divide(dot(a, b), norms)).otherwise(F.lit(0.0))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays."""
    a = col(a)
    n = norm(a)
    return F.transform(a, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))


def combine(a: Column | str, b: Column | str, weight: float) -> Column:
    """weight * a + (1 - weight) * b."""
    return F.zip_with(col(a), col(b), lambda x, y: F.lit(float(weight)) * x.cast("double") + F.lit(float(1 - weight)) * y.cast("double"))
