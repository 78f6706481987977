"""N-gram Jaccard self-join: all documents whose sets of word n-grams are alike, by a size-aware heavy-light join.

Two sets of s and t n-grams link if they share at least ``need(s, t)``. Light sets, small ones, name every subset of that size
they hold; sets that name one subset are linked, without any comparison. Heavy sets scan inverted lists, and what meets in a list
is verified. The boundary between them is the size at which naming subsets would cost more rows than the lists are long.

The lists hold a prefix of each set only. In any common order of n-grams, the k first common ones of two linked sets stand among
the s - need + k first of either. A first such prefix, by hash value, keeps the table of n-gram frequencies small; inside it a
second one, rarest n-grams first, leaves out what many documents share. Both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.columns import keeping
from millrace.llm.hotkeys import left_join
from millrace.llm.simhash import _first_rows, shingle_hashes
from millrace.llm.textbatch import BATCH_BYTES, pieces, trimmed
from millrace.operators.components import component_labels
from millrace.plans.materialize import broadcast_if_small, free, materialize, shuffle_parts

#: Largest size for which naming subsets is considered; their number explodes beyond.
LIGHT = 24
#: List entries that cost as much as one named subset: that is hashed in Python, shuffled and grouped, an entry is a row of an array.
SUBSET = 16
#: Bits of a set's parity sketch, and members of a list that one task compares; longer lists are dealt over pairs of blocks.
BITS, BLOCK = 512, 1 << 14
#: Distances in a list, in order of size, at which members of different classes meet, round after round; the last has no end.
ROUNDS = ((0, 16), (16, 256), (256, 1 << 60))
#: Lists of a member, the first ones, by which a list knows that an earlier one tells a pair.
FIRST = 8


def need(s, t, percent: int):
    """Least common n-grams of linked sets of sizes s and t: (100 + percent) * common >= percent * (s + t)."""
    return -(-percent * (s + t) // (100 + percent))


def least_partner(s, percent: int):
    return -(-percent * s // 100)


def _slack(s: int) -> int:
    """Common n-grams by which the first prefix is longer than it must be; of them the second one may leave out the most frequent."""
    return max(1, s // 10)


def first_prefix(s: int, percent: int) -> int:
    """n-grams, least hashes first, among which linked sets have min(_slack(s), _slack(t)) in common."""
    return s if s <= LIGHT else min(s, s - least_partner(s, percent) + _slack(s))


def second_prefix(s: int, percent: int) -> int:
    """Of these, rarest first, how many must hold a common one: all but what the smallest partner's slack leaves over."""
    slack = _slack(least_partner(s, percent)) if s > LIGHT else least_partner(s, percent)
    return first_prefix(s, percent) - min(slack, _slack(s)) + 1


def subset_sizes(s: int, most: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of size s names, for partners of at most ``most`` n-grams."""
    return sorted({need(s, t, percent) for t in range(least_partner(s, percent), most + 1) if least_partner(t, percent) <= s})


def ngram_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word n-grams."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def _binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _sets(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the text, by the set's size, its 128-bit name and its first prefix."""
    for batch in batches:
        n, k1, k2, prefix = [], [], [], []
        for _, texts in pieces(batch, batch.schema.names[-1]):
            for text in texts:
                x = ngram_set(text, width)
                body = x.tobytes()
                n.append(len(x))
                k1.append(xxhash.xxh64_intdigest(body, 1))
                k2.append(xxhash.xxh64_intdigest(body, 2))
                prefix.append(x[: first_prefix(len(x), percent)])
        names = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int32()), *names, _binary(prefix)], names=[*batch.schema.names[:-1], "n", "k1", "k2", "prefix"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, prefix) to (g, id)."""
    for batch in batches:
        ids, prefix = batch.column(0).to_numpy(), batch.column(1)
        for at in range(0, len(ids), 256):
            x = [np.frombuffer(p.as_py(), np.int64) for p in prefix[at : at + 256]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])), pa.array(np.repeat(ids[at : at + 256], [len(v) for v in x]))], names=["g", "id"])


def _subsets(batches: Iterator[pa.RecordBatch], most: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, whole set) of light sets to (key, c, id, n): every subset of each size c that is asked for."""
    for batch in batches:
        key, size, id_, n_ = [], [], [], []
        for i, n, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            grams = [body[8 * k : 8 * k + 8] for k in range(n)]
            for c in subset_sizes(n, most, percent):
                found = [xxhash.xxh64_intdigest(b"".join(x), c) for x in combinations(grams, c)]
                key += found
                size += [c] * len(found)
                id_ += [i] * len(found)
                n_ += [n] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(id_, pa.int64()), pa.array(n_, pa.int32())], names=["key", "c", "id", "n"])


def light_links(light: DataFrame, most: int, percent: int) -> DataFrame:
    """Links (a, b) of the sets (id, n, prefix: whole set) of at most ``most`` n-grams, as stars whose components are those of all.

    Of the sets that name a subset of c n-grams, two link by it if need(s, t) <= c. The smallest links with every set that any
    other one links with, so it alone is joined with the others.
    """
    named = light.select("id", "n", "prefix").mapInArrow(trimmed(lambda it: _subsets(it, most, percent)), "key long, c int, id long, n int")
    named = materialize(named)
    hubs = named.groupBy("key", "c").agg(F.min(F.struct("n", "id")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "c", "hub.*").toDF("key", "c", "hub_n", "hub")
    linked = named.join(hubs, ["key", "c"]).where((F.col("id") != F.col("hub")) & ((F.col("n") + F.col("hub_n")) * percent <= F.col("c") * (100 + percent)))
    links = materialize(linked.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    free(named)
    return links


def boundary(sizes: dict[int, int], scanned: dict[int, int], percent: int) -> int:
    """The size up to which sets are light: least cost of subsets named up to it and list entries scanned above it.

    ``sizes`` counts sets by size, ``scanned`` sums the lengths of their lists; both for sizes up to LIGHT.
    """
    costs = {}
    for most in range(LIGHT + 1):
        subsets = sum(n * sum(comb(s, c) for c in subset_sizes(s, most, percent)) for s, n in sizes.items() if s <= most)
        costs[most] = SUBSET * subsets + sum(n for s, n in scanned.items() if s > most)
    return min(costs, key=lambda x: (costs[x], x))


# --- inverted lists -------------------------------------------------------------------------------------------------------------


def _content(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to (id, n, grams, sketch): the whole set, and for each of BITS bins whether an odd number falls in it."""
    for batch in batches:
        sets = [ngram_set(t.as_py(), width) for t in batch.column(1)]
        sketch = [np.packbits(np.bincount((x % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), _binary(sets), _binary(sketch)], names=["id", "n", "grams", "sketch"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, grams of a, grams of b) to the (a, b) that link."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            short, long_ = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(long_, short), len(long_) - 1)
            ok.append(int((long_[at] == short).sum()) >= need(len(x), len(y), percent))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


_NO_LIST = (1 << 63) - 1  # no list is less than another by it


def _meet(batches: Iterator[pa.RecordBatch], percent: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, id, label, sketch, most, g, first), sorted, to pairs (a, b) of one key that may link though their labels differ.

    Only members more than ``low`` and at most ``high`` places apart are told. The bins in which parities differ are no more than
    the n-grams that are in one set only, so no linked pair is left out. Of two light sets (at most ``most``) nothing is told.
    A pair that meets in many lists is left to the least of them: ``first`` are a member's least lists, and where two have one in
    common that is less than this list g, that one tells the pair, in the round of its distance there.
    """
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, n, id_, label, most, g = (table.column(c).to_numpy() for c in ("key", "n", "id", "label", "most", "g"))
        lists = table.column("first").to_pylist()
        first = np.array([x + [_NO_LIST] * (FIRST - len(x)) for x in lists], np.int64)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(key), -1)
        n = n.astype(np.int64)
        # a key's members are sorted by size, and those too large for a member are no more than a prefix of what follows
        end = np.searchsorted(key, key, "right")
        a, b = [], []
        for i in range(len(key) - 1):
            j = np.arange(i + 1 + low, min(end[i], i + 1 + min(high, len(key))))
            j = j[(label[j] != label[i]) & (least_partner(n[j], percent) <= n[i]) & (n[j] > most[i])]
            if len(j):
                apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
                j = j[apart <= n[i] + n[j] - 2 * need(n[i], n[j], percent)]
                if len(j):
                    j = j[~np.isin(first[j], first[i][first[i] < g[i]]).any(1)]
                a.append(np.full(len(j), id_[i]))
                b.append(id_[j])
                if len(a) > 4096:
                    yield pairs(a, b)
                    a, b = [], []
        yield pairs(a, b)

    def pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(0).to_numpy()
        if key[0] == key[-1]:  # a list that goes on; its length is bounded by the deal
            continue
        table = pa.Table.from_batches(held)
        cut = len(table) - int((key == key[-1]).sum())
        held = table.slice(cut).to_batches()
        yield from solve(table.slice(0, cut))
    if held:
        yield from solve(pa.Table.from_batches(held))


def _dealt(lists: DataFrame, block: int) -> DataFrame:
    """Rows (g, ...) with a ``key`` in place of g: lists above ``block`` members become one key for each pair of their blocks."""
    long_ = lists.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
    long_ = materialize(long_.select("g", F.ceil(F.col("m") / (block // 2)).cast("int").alias("blocks")))
    rest = [c for c in lists.columns if c != "g"]
    if long_.isEmpty():
        return lists.withColumnRenamed("g", "key").select("key", *rest)
    both = lists.join(long_, "g", "left").withColumn("mine", F.pmod(F.xxhash64("g", "id"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.withColumn("other", other)
    key = F.when(F.col("blocks").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other")))
    return both.select(key.alias("key"), *rest)


def _postings(prefixes: DataFrame, percent: int) -> DataFrame:
    """(g, df, id, n) of each set's second prefix, for n-grams in the first prefix of two sets or more."""
    spread = prefixes.select("id", "prefix").mapInArrow(trimmed(_spread), "g long, id long")
    shared = spread.withColumn("df", F.count(F.lit(1)).over(W.Window.partitionBy("g"))).where("df > 1")
    shared = shared.join(prefixes.select("id", "n"), "id")
    # what a set holds alone comes first in the order of frequency
    sizes = prefixes.select("n").distinct()
    lengths = sizes.mapInArrow(trimmed(lambda it: _lengths(it, percent)), "n int, whole int, take int")
    mine = W.Window.partitionBy("id")
    ranked = shared.join(lengths, "n").withColumn("r", F.row_number().over(mine.orderBy("df", "g"))).withColumn("m", F.count(F.lit(1)).over(mine))
    return ranked.where(F.col("r") <= F.col("take") - (F.col("whole") - F.col("m"))).select("g", "df", "id", "n")


def _lengths(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([first_prefix(s, percent) for s in n], pa.int32()), pa.array([second_prefix(s, percent) for s in n], pa.int32())], names=["n", "whole", "take"])


@keeping("n_shingles", "component_id")
def link_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 85, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (``doc_id`` by default) with ``n_shingles`` (size of the set) and ``component_id`` (smallest id reachable).

    A document's set holds its distinct n-grams of ``width`` words (lower-cased A-Z, split at ASCII spaces); with fewer words, all of
    them as one. Documents link if 100 * common >= ``percent`` * union. Null texts and texts without words have an empty set and
    link with nothing, so they are their own component. Null ids are ignored in the minimum, so a component of null ids has a
    null id. Rows that repeat stay repeated and are linked (their sets are equal). Columns of ``keep`` may have any names.

    Equal sets are one class, so copies count once. Each member of a list is verified against its smallest member first; then,
    round by round, members of lists that still hold several components meet at growing distances, the last without a bound:
    at the end no pair that shares an n-gram of both prefixes is in two components without having been refused, by sketch or sets.
    """
    keep = [doc_id] if keep is None else keep
    names = [f"{prefix}n_shingles", f"{prefix}component_id"]
    if clash := {x.lower() for x in names} & {x.lower() for x in keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    body = F.coalesce(F.col(text), F.lit(""))
    t = [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("b"), body).alias("t2")]
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    source = docs.select(*kept, F.col(doc_id).alias("doc"), *t, body.alias("body"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.drop("body").schema)
    rows = materialize(source.mapInArrow(trimmed(lambda it: _sets(it, width, percent)), f"{fields}n int, k1 long, k2 long, prefix binary").withColumn("row", F.monotonically_increasing_id()), batch_bytes=BATCH_BYTES)
    classes = materialize(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("id"), F.min("doc").alias("low"), F.count(F.lit(1)).alias("copies")))
    firsts = rows.select(F.col("row").alias("id"), "n", "prefix", "t1", "t2").join(broadcast_if_small(classes.select("id")), "id", "left_semi")
    firsts = materialize(firsts)

    postings = materialize(_postings(firsts, percent))
    count = lambda frame, value: {r[0]: r[1] for r in frame.where(F.col("n") <= LIGHT).groupBy("n").agg(value).collect()}
    most = boundary(count(firsts, F.count(F.lit(1))), count(postings, F.sum("df")), percent)
    links = light_links(firsts.where(F.col("n") <= most), most, percent)
    # a light set stays in the lists if a heavy one may link with it
    lists = postings.where(F.col("n") >= least_partner(most + 1, percent)).select("g", "id", "n")

    hubs = lists.groupBy("g").agg(F.min(F.struct("n", "id")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("g", "hub.*").toDF("g", "hub_n", "hub")
    met = lists.join(hubs, "g").where((F.col("id") != F.col("hub")) & (F.col("n") > most) & (F.col("n") * percent <= F.col("hub_n") * 100))
    pairs = materialize(met.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct())
    # whatever may link is in a list of two or more
    wanted = lists.join(hubs.select("g"), "g", "left_semi").select("id").distinct().join(firsts.select("id", "t1", "t2"), "id")
    once = source.select("t1", "t2", "body").mapInArrow(trimmed(_first_rows), "t1 long, t2 long, body string")
    found = once.join(broadcast_if_small(materialize(wanted)), ["t1", "t2"]).select("id", "body").mapInArrow(trimmed(lambda it: _content(it, width)), "id long, n int, grams binary, sketch binary")
    content = materialize(found.dropDuplicates(["id"]), batch_bytes=BATCH_BYTES)

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda k, c: content.select(F.col("id").alias(k), F.col("grams").alias(c))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
        return materialize(both.mapInArrow(trimmed(lambda it: _linked(it, percent)), "a long, b long"), batch_bytes=BATCH_BYTES)

    labels, tried = component_labels(links.union(verified(pairs))), pairs
    for low, high in ROUNDS:
        labelled = lists.join(labels.withColumnRenamed("node", "id"), "id", "left").select("g", "id", "n", F.coalesce("label", "id").alias("label"))
        labelled = materialize(labelled)
        mixed = labelled.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("g")
        if mixed.isEmpty():
            break
        mine = labelled.join(mixed, "g", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.sort_array(F.collect_list("g")).alias("lists"))
        mine = mine.join(content.select("id", "sketch"), "id").withColumn("first", F.slice("lists", 1, FIRST))
        open_ = mine.select(F.explode("lists").alias("g"), "n", "id", "label", "sketch", F.lit(most).alias("most"), "first").withColumn("list", F.col("g"))
        keyed = _dealt(open_, BLOCK).withColumnRenamed("list", "g").select("key", "n", "id", "label", "sketch", "most", "g", "first")
        keyed = keyed.repartition(shuffle_parts(docs.sparkSession), "key").sortWithinPartitions("key", "n", "id")
        pairs = keyed.mapInArrow(trimmed(lambda it, low=low, high=high: _meet(it, percent, low, high)), "a long, b long").distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"))
        new, tried = verified(pairs), tried.union(pairs)
        if not new.isEmpty():
            labels = component_labels(new.union(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))
        free(labelled, new)
    told = classes.join(labels, classes["id"] == labels["node"], "left").select("k1", "k2", "low", "copies", F.coalesce("label", "id").alias("root"))
    lowest = told.groupBy("root").agg(F.min("low").alias("component"))
    found = materialize(told.join(lowest, "root").select("k1", "k2", "component", "copies"))
    free(firsts, postings, content)
    out = left_join(rows.drop("prefix"), found, ["k1", "k2"], "copies")
    component = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("n").cast("long").alias(names[0]), component.alias(names[1]))
