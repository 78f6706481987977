"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean repetition rate so that its expected bytes match its weight. A document's count is the inverse of the
Poisson distribution of that mean at a uniform number hashed from its id, so it needs no state and is the same in every run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.columns import keeping
from millrace.plans.materialize import broadcast_if_small, materialize, shuffle_parts

#: The hash gives 13 hexadecimal digits, 52 bits, of which a double holds all.
DIGITS = 13
#: Equal parts of [0, 1) by which uniform numbers meet the steps of a distribution: also what spreads a hot source over tasks.
BUCKETS = 256


def uniform(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) from the MD5 of the parts joined by ``#`` (null as ``~``)."""
    text = F.concat_ws("#", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def _log_poisson(rate: Column, k: Column) -> Column:
    """Logarithm of P(count = k): by factorials up to 20, else by Stirling's series, in a form that cancels no large terms."""
    x = k.cast("double")
    d = (rate - x) / x
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    large = x * (F.log1p(d) - d) - F.ln(2 * math.pi * x) / 2 - series
    return F.when(k <= 20, -rate + x * F.ln(rate) - F.ln(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(large)


def poisson_table(rates: DataFrame) -> DataFrame:
    """(source, k, bucket, low, high) of rows (source, rate): P(count < k) and P(count <= k) for each bucket of u they lie in.

    Only the counts within ten standard deviations have rows, about 20 * sqrt(rate) + 80 of a source, in place of one for each count up to the
    rate; beyond them nothing is left at the grain of the hash. A uniform number u in bucket floor(u * BUCKETS) is inverted by
    the one row with low <= u < high. A rate of 0 has no rows.
    """
    spread = F.sqrt("rate") * 10 + 20
    first = F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("long")
    counts = rates.where("rate > 0").select("source", "rate", first.alias("first"), F.explode(F.sequence(first, F.ceil(F.col("rate") + spread + 40).cast("long"))).alias("k"))
    order = W.Window.partitionBy("source").orderBy("k")
    total = F.least(F.lit(1.0), F.sum(F.exp(_log_poisson(F.col("rate"), F.col("k")))).over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    summed = counts.select("source", "k", total.alias("high")).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    summed = summed.withColumn("high", F.when(F.lead("high").over(order).isNull(), 2.0).otherwise(F.col("high"))).where("high > low")
    at = lambda c: F.least(F.floor(F.col(c) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return summed.select("source", "k", F.explode(F.sequence(at("low"), at("high"))).alias("bucket"), "low", "high")


def source_rates(docs: DataFrame, source: str, size: Column, weights: dict[str, float] | None, default_weight: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """(source, bytes, rate): rate = weight share x total bytes x epochs / bytes of the source; a null source is one of its own."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("bytes"))
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(name), F.lit(float(value))).otherwise(weight)
    sizes = materialize(sizes.withColumn("weight", weight))
    total = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("bytes") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_bytes") * F.lit(float(epochs)) / F.col("bytes")).otherwise(F.lit(0.0))
    return sizes.crossJoin(F.broadcast(total)).select("source", "bytes", rate.alias("rate"))  # one row of totals


@keeping("copies", "copy_no", "mix_key", all_columns=True)
def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = 17,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    shuffle: bool = True,
    prefix: str = "",
) -> DataFrame:
    """Repeat each document by its Poisson count and put the result in a globally random order.

    Adds ``copies`` (the count), ``copy_no`` (from 1) and ``mix_key`` (uniform; the order of the shuffled result). Documents of
    count 0 leave the mixture. A document counts its UTF-8 bytes plus 1, so empty and null texts have a size too. Rows with
    the same id share a count; a null id hashes as ``~``. An empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    names = [f"{prefix}{x}" for x in ("copies", "copy_no", "mix_key")]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    rates = source_rates(docs, source, size, weights, default_weight, epochs)
    steps = materialize(poisson_table(rates).where("k > 0").toDF("__source", "__k", "__bucket", "__low", "__high"))
    u = uniform(F.lit(f"count-{seed}"), doc_id)
    # rows of fixed width: broadcast while they are few, else a join on source and bucket
    rows = docs.select(*keep, F.col(source).alias("__s"), F.col(doc_id).alias("__id"), u.alias("__u")).withColumn("__b", F.floor(F.col("__u") * BUCKETS).cast("int"))
    on = F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__b") == F.col("__bucket")) & (F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high"))
    counted = rows.join(broadcast_if_small(steps), on).select(*keep, "__id", F.col("__k").cast("int").alias(names[0]))
    copies = counted.select("*", F.explode(F.sequence(F.lit(1), F.col(names[0]))).alias(names[1]))
    out = copies.withColumn(names[2], uniform(F.lit(f"order-{seed}"), "__id", names[1])).select(*keep, *names)
    if not shuffle:
        return out
    return out.repartitionByRange(shuffle_parts(docs.sparkSession), names[2]).sortWithinPartitions(names[2])
