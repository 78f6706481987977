"""Entity resolution: blocked candidate pairs, token rules, components, and canonical linking across corpora."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions import text as T
from millrace.operators.components import component_labels
from millrace.operators.joins import TILE, unit_vectors
from millrace.plans.materialize import free, materialize

# Fixed values.
STOPWORDS = ["the", "a", "an", "of", "in", "for", "and", "or", "to", "with", "by", "on", "at"]
JACCARD, RATIO = 0.55, 0.80


def _ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if SequenceMatcher(None, p, q).ratio() >= RATIO]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])


#: Names of one key that are compared in one block; larger keys are dealt over blocks, each pair of blocks met once.
BLOCK = 1000


def candidate_pairs(entities: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, norms, tokens, stems) of unlike names of one kind that share a token or the first three characters.

    Equal names are one: the least id stands for them. However common a key is, none is left out.
    """
    e = entities.withColumn("norm", T.normalize_label("name"))
    e = e.groupBy("kind", "norm").agg(F.min("id").alias("id"))
    words = F.filter(F.split(F.regexp_replace("norm", r"[()]", " "), r"\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))
    e = e.withColumn("tokens", F.array_distinct(words)).withColumn("stems", F.array_distinct(F.transform("tokens", lambda t: F.when(F.length(t) > 2, F.regexp_replace(t, "s$", "")).otherwise(t))))
    keyed = e.select("id", "kind", "norm", "tokens", "stems", F.explode(F.array_distinct(F.concat("stems", F.array(F.concat(F.lit("^"), F.substring("norm", 1, 3)))))).alias("key"))
    blocks = keyed.groupBy("kind", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keyed = keyed.join(blocks, ["kind", "key"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    side = lambda s: keyed.select("kind", "key", "i", "j", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "norm", "tokens", "stems")])
    return side("a").join(side("b"), ["kind", "key", "i", "j"]).where("id_a < id_b").dropDuplicates(["id_a", "id_b"])


def _same_names(entities: DataFrame) -> DataFrame:
    """(a, b): the least id of equal names of a kind, with each other one; one-letter names and stopwords name nothing."""
    e = entities.withColumn("norm", T.normalize_label("name"))
    words = F.filter(F.split(F.regexp_replace("norm", r"[()]", " "), r"\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))
    e = e.where((F.length("norm") >= 4) | (F.size(words) > 0))
    low = e.groupBy("kind", "norm").agg(F.min("id").alias("a"))
    return e.join(low, ["kind", "norm"]).where("id <> a").select("a", F.col("id").alias("b"))


def match_pairs(entities: DataFrame) -> DataFrame:
    """(a, b) that name the same: substring, token or stem subset, token overlap, or a similar spelling."""
    p = candidate_pairs(entities)
    short, long = F.when(F.length("norm_a") <= F.length("norm_b"), F.col("norm_a")).otherwise(F.col("norm_b")), F.when(F.length("norm_a") <= F.length("norm_b"), F.col("norm_b")).otherwise(F.col("norm_a"))
    subset = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    rule = ((F.length(short) >= 4) & F.contains(long, short)) | subset("tokens_a", "tokens_b") | subset("stems_a", "stems_b") | (T.jaccard(F.col("tokens_a"), F.col("tokens_b")) >= JACCARD)
    p = p.withColumn("rule", rule)
    lengths = F.least(F.length("norm_a"), F.length("norm_b")) / F.greatest(F.length("norm_a"), F.length("norm_b"))
    spelled = p.where(~F.col("rule") & (F.length(short) >= 4) & (lengths >= 0.8)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "norm_a", "norm_b")
    kind = entities.schema["id"].dataType.simpleString()
    named = _same_names(entities)
    return named.union(p.where("rule").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).union(spelled.mapInArrow(_ratio, f"a {kind}, b {kind}"))


def resolve(entities: DataFrame) -> DataFrame:
    """(old, new): each entity's primary, the most confident of all connected ones (ties: smaller id).

    Matches are closed transitively, so the result doesn't depend on the order of entities.
    """
    labels = component_labels(match_pairs(entities))
    groups = labels.join(entities.select(F.col("id").alias("node"), "confidence"), "node")
    first = W.Window.partitionBy("label").orderBy(F.desc("confidence"), "node")
    primary = groups.withColumn("n", F.row_number().over(first)).where("n = 1").select("label", F.col("node").alias("new"))
    return groups.join(primary, "label").where("node <> new").select(F.col("node").alias("old"), "new")


def _nearest(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, cid, s): each entity's canonical one of its kind with the largest cosine (to 12 decimals; ties: the larger id).

    Both sides of a kind are dealt over tiles; each pair of tiles meets once in a matrix product and passes on one row an entity.
    """
    kind, other = entities.schema["id"].dataType.simpleString(), canonical.schema["id"].dataType.simpleString()
    usable = lambda x: x.where(F.col("kind").isNotNull() & (F.size("vector") > 0)).select("kind", "id", F.size("vector").alias("n"), F.col("vector").cast("array<double>").alias("v"))
    mine, theirs = usable(entities), usable(canonical)
    tiles = lambda x, name: x.groupBy("kind", "n").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name))
    sizes = tiles(mine, "rows").join(tiles(theirs, "columns"), ["kind", "n"])

    def dealt(x: DataFrame, own: str, across: str, i: str, j: str) -> GroupedData:
        tile, met = F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(across) - 1))
        # renamed by toDF, so that two sides cut from one table stay apart
        return x.join(sizes, ["kind", "n"]).select("kind", "n", "id", "v", tile, met).toDF("kind", "n", "id", "v", i, j).groupBy("kind", "n", "i", "j")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"id": left.column("id").slice(0, 0), "cid": right.column("id").slice(0, 0), "s": np.zeros(0)})
        right = right.sort_by([("id", "descending")])
        s = np.round(unit_vectors(left.column("v")) @ unit_vectors(right.column("v")).T, 12)
        at = s.argmax(1)
        return pa.table({"id": left.column("id"), "cid": right.column("id").take(pa.array(at)), "s": s[np.arange(len(at)), at]})

    met = dealt(mine, "rows", "columns", "i", "j").cogroup(dealt(theirs, "columns", "rows", "j", "i")).applyInArrow(best, f"id {kind}, cid {other}, s double")
    return met.groupBy("id").agg(F.max(F.struct("s", "cid")).alias("m")).select("id", "m.cid", "m.s")


def link_canonical(entities: DataFrame, canonical: DataFrame, merge: float = 0.88, review: float = 0.75) -> DataFrame:
    """(id, canonical_id, decision): exact name and kind, else the nearest vector of the kind: merge, review or new."""
    e = entities.withColumn("norm", T.normalize_label("name"))
    c = canonical.withColumn("norm", T.normalize_label("name"))
    exact = e.join(c.groupBy("norm", "kind").agg(F.min("id").alias("canonical_id")), ["norm", "kind"]).select("id", "canonical_id", F.lit("exact").alias("decision"))
    rest = e.join(exact.select("id"), "id", "left_anti")
    best = _nearest(rest, c)
    linked = rest.select("id").join(best, "id", "left")
    decision = F.when(F.col("s") >= merge, "merge").when(F.col("s") >= review, "review").otherwise("new")
    return exact.union(linked.select("id", F.when(decision != "new", F.col("cid")), decision))


def flatten_chains(hops: DataFrame) -> DataFrame:
    """(old, new) with every chain of hops (old, new) followed to its end: A to B and B to C give A to C and B to C.

    Each round doubles the length of what has been followed, so a chain of n hops takes log n joins. Of several hops from one
    ``old`` the least ``new`` counts; hops to itself and nulls are left out. Where a chain ends in a circle there is no end: such
    rows keep their own first hop.
    """
    first = materialize(hops.where("old is not null and new is not null and old <> new").groupBy("old").agg(F.min("new").alias("new")))
    found = first
    for _ in range(first.count().bit_length() + 1):
        ahead = found.select(F.col("old").alias("new"), F.col("new").alias("next"))
        if found.join(ahead, "new", "left_semi").isEmpty():
            return found
        done, found = found, materialize(found.join(ahead, "new", "left").select("old", F.coalesce("next", "new").alias("new")))
        if done is not first:
            free(done)
    circling = found.join(found.select(F.col("old").alias("new")), "new", "left_semi").select("old")
    return found.join(circling, "old", "left_anti").unionByName(first.join(circling, "old", "left_semi"))


def resolve_with_vectors(entities: DataFrame, existing: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(old, new, old_label, new_label, stage): what each merged entity becomes, and its label, chains followed to the end.

    ``entities``: (id, name, kind, confidence, vector); ``existing``: (id, name, kind, vector). Stage ``name``: an entity of the
    batch names the same (``resolve``). Stage ``vector``: one that is left is as near as ``threshold`` (cosine) to an existing
    entity of its kind, the nearest one counts. An entity that goes by name to one that goes by vector ends at the existing one.
    """
    named = materialize(resolve(entities))
    left = entities.join(named.select(F.col("old").alias("id")), "id", "left_anti")
    near = _nearest(left.select("id", "kind", "vector"), existing.select("id", "kind", "vector")).where(F.col("s") >= threshold)
    near = materialize(near.select(F.col("id").alias("old"), F.col("cid").alias("new")).where("old <> new"))
    hops = flatten_chains(named.unionByName(near))
    labels = entities.select(F.col("id").alias("i"), F.col("name").alias("label")).unionByName(existing.select(F.col("id").alias("i"), F.col("name").alias("label"))).groupBy("i").agg(F.min("label").alias("label"))
    out = hops.join(labels.toDF("old", "old_label"), "old").join(labels.toDF("new", "new_label"), "new", "left")
    stage = near.select("old").withColumn("stage", F.lit("vector"))
    return out.join(stage, "old", "left").select("old", "new", "old_label", "new_label", F.coalesce("stage", F.lit("name")).alias("stage"))
