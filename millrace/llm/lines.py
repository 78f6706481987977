"""Line dedup with DataFrame functions only: exact copies, and lines within one character edit of an earlier line.

A deletion-neighbourhood join. Two lines are within one edit if they are equal after one character is deleted from one of them
(insertion) or from both at the same place (substitution). Each line emits the hashed keys of its deletion variants; lines with an
equal key are linked through the earliest of them, so a template with a thousand variants gives a thousand links, not a million.

Emitting a variant for every character of every line would cost the square of a line's length. An exact reduction avoids that: two
lines within one edit are equal but for one block of any division into blocks. Lines emit a key for each block, made of all that
stands before and after it, first for halves and then for ever smaller blocks; those whose key no other line has go no further.
Deletion variants are taken from the last, short block only, and carry its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import keeping
from millrace.plans.materialize import broadcast_if_small, materialize

#: Parts a block is divided into, and the characters of a block that is not divided further.
PARTS, BLOCK = 16, 24
KEY = ["k1", "k2"]


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("b"), line).alias("k2")]


def _half_keys(line: Column, least: int) -> Column:
    """Hashes of the first and the last h characters, where h is half the length of the line or of one a character shorter."""
    n = F.length(line)

    def halves(h: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), h, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit("last"), h, F.substring(line, n - h + 1, h))]

    keys = F.array_distinct(F.array(*halves((n / 2).cast("int")), *halves(((n - 1) / 2).cast("int"))))
    return F.when(n >= least, keys).otherwise(F.expr("cast(array() as array<bigint>)"))


def _blocks(texts: DataFrame) -> DataFrame:
    """(k1, k2, pos, size, key, middle): each line's short blocks outside of which another line agrees with it.

    ``size`` is the length of the shorter line of a pair: a line takes part as the shorter or equal one with its own length, and
    as the longer one with a length less by one; blocks are counted by ``size`` from the left and from the right.
    """
    lines = texts.select(*KEY, "pos", "line", F.length("line").alias("n"))
    size = F.explode(F.array(F.col("n"), F.col("n") - 1))
    open_ = lines.select(*KEY, size.alias("size"), F.lit(0).alias("before"), F.lit(0).alias("after"))
    done = None
    while True:
        middle = F.col("size") - F.col("before") - F.col("after")
        part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        split = open_.withColumn("mid", middle).withColumn("j", part)
        edge = lambda j: (F.col("before") + F.floor(F.col("mid") * j / PARTS)).cast("int")
        split = split.select(*KEY, "size", edge(F.col("j")).alias("x"), edge(F.col("j") + 1).alias("y")).where("y > x").distinct()
        split = split.select(*KEY, "size", F.col("x").alias("before"), (F.col("size") - F.col("y")).alias("after"))
        key = F.xxhash64("size", "before", "after", F.substring("line", F.lit(1), F.col("before")), F.substring("line", F.col("n") - F.col("after") + 1, F.col("after")))
        keyed = materialize(split.join(lines.select(*KEY, "line", "n"), KEY).select(*KEY, "size", "before", "after", key.alias("key")))
        shared = keyed.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("key")
        kept = materialize(keyed.join(shared, "key", "left_semi"))
        short = kept.where(middle <= BLOCK)
        done = short if done is None else done.union(short)
        open_ = kept.where(middle > BLOCK)
        if open_.isEmpty():
            break
    cut = F.substring("line", F.col("before") + 1, F.col("n") - F.col("before") - F.col("after"))
    return done.join(lines, KEY).select(*KEY, "pos", "key", (F.col("n") - F.col("size")).alias("longer"), cut.alias("middle"))


def _links(lines: DataFrame) -> DataFrame:
    """(k1, k2, to): each line with an earlier one that shares a deletion variant; ``lines`` has (k1, k2, pos, line)."""
    without = lambda p: F.concat(F.substring("middle", F.lit(1), p - 1), F.substring("middle", p + 1, F.length("middle")))
    place = F.when(F.length("middle") > 0, F.sequence(F.lit(1), F.length("middle"))).otherwise(F.expr("cast(array() as array<int>)"))
    # kind 0: the block as it is; 1: of the longer line, one character deleted; 2: one deleted at this place (substitution)
    same = F.array(F.struct(F.xxhash64("key", "middle").alias("key"), F.lit(0).alias("kind")))
    deleted = F.transform(place, lambda p: F.struct(F.xxhash64("key", without(p)).alias("key"), F.lit(1).alias("kind")))
    replaced = F.transform(place, lambda p: F.struct(F.xxhash64("key", without(p), p).alias("key"), F.lit(2).alias("kind")))
    variants = F.when(F.col("longer") == 1, deleted).otherwise(F.concat(same, replaced))
    keyed = _blocks(lines).select(*KEY, "pos", F.explode(variants).alias("v")).select(*KEY, "pos", "v.*").distinct()
    # kinds 0 and 1 meet in a key of their own; kind 2 among themselves: all those of a key are within one edit of each other
    group = F.when(F.col("kind") == 2, F.lit(2)).otherwise(F.lit(1)).alias("group")
    keyed = materialize(keyed.select(*KEY, "pos", "key", group, "kind"))
    earliest = keyed.groupBy("key", "group").agg(F.min(F.when(F.col("kind") == 0, F.col("pos"))).alias("same"), F.min(F.when(F.col("kind") != 0, F.col("pos"))).alias("shorter"), F.count(F.lit(1)).alias("n"))
    other = F.when(F.col("kind") == 1, F.col("same")).otherwise(F.col("shorter"))
    joined = keyed.join(earliest.where("n > 1"), ["key", "group"]).select(*KEY, "pos", other.alias("to"))
    return joined.where(F.col("to").isNotNull() & (F.col("to") < F.col("pos"))).select(*KEY, "to").distinct()


def near_lines(lines: DataFrame) -> DataFrame:
    """(k1, k2) of the lines within one edit of an earlier line, verified by edit distance; ``lines``: (k1, k2, pos, line)."""
    links = _links(lines)
    text = lines.select(F.col("pos").alias("to"), F.col("line").alias("other"))
    pairs = links.join(text, "to").join(lines.select(*KEY, "line"), KEY)
    return pairs.where(F.levenshtein("line", "other", 1).between(0, 1)).select(*KEY).distinct()


@keeping("n_lines", "n_removed", "kept_text", all_columns=True)
def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = 20, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns with ``n_lines``, ``n_removed`` and ``kept_text``: the text without lines that repeat an earlier one.

    Lines end at a newline. A line goes if it equals an earlier line of the corpus or, from ``least_chars`` characters on, is
    within one character edit of an earlier one (earlier lines that go count too, so the result has no order of its own).
    Earlier: by document id (null last), then row, then place. Lines of white space always stay. Null text has no lines and stays
    null; an empty text has one empty line.
    """
    keep = docs.columns if keep is None else keep
    names = [f"{prefix}{x}" for x in ("n_lines", "n_removed", "kept_text")]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    rows = docs.select(*keep, F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    rows = materialize(rows)
    lines = rows.select("__id", "__row", F.posexplode(F.split("__text", "\n", -1)).alias("n", "line"))
    pos = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("n"))
    lines = lines.select("__row", "n", pos.alias("pos"), F.length(F.trim(F.regexp_replace("line", r"\s+", ""))).alias("ink"), *_line_key(F.col("line")), "line")
    lines = lines.where("ink > 0")
    table = materialize(lines.select("__row", "n", "pos", *KEY, _half_keys(F.col("line"), least_chars - 1).alias("halves")))
    first = materialize(table.groupBy(*KEY).agg(F.min("pos").alias("first")))

    # lines that share half with another line
    halves = table.select(F.explode("halves").alias("half"), *KEY)
    shared = halves.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("half")
    chosen = materialize(halves.join(shared, "half", "left_semi").select(*KEY).distinct())
    texts = lines.select(*KEY, "pos", "line").join(broadcast_if_small(chosen), KEY, "left_semi")
    # one row a line: the earliest
    texts = materialize(texts.join(first.select(F.col("first").alias("pos")), "pos", "left_semi"))
    # an earlier line may be a character shorter than those that go
    long = texts.where(F.length("line") >= least_chars).select(*KEY)
    near = materialize(near_lines(texts).join(long, KEY, "left_semi").withColumn("near", F.lit(True)))

    judged = table.select("__row", "n", "pos", *KEY).join(first, KEY).join(broadcast_if_small(near), KEY, "left")
    gone = (F.col("pos") != F.col("first")) | F.coalesce("near", F.lit(False))
    removed = judged.where(gone).groupBy("__row").agg(F.array_sort(F.collect_list("n")).alias("removed"))
    out = rows.join(removed, "__row", "left")
    body = F.split("__text", "\n", -1)
    # runs of lines between those that go
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r + 1))
    ends = F.concat(F.col("removed"), F.array(F.size(body)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(body, a + 1, b - a))
    left = F.when(F.col("removed").isNull(), F.col("__text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return out.select(*keep, F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size(body)).cast("long").alias(names[0]), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias(names[1]), left.alias(names[2]))
