"""Filter interaction audit: what each of several filters removes in every order in which they could be applied.

A document is removed by the first filter of an order that it fails, so an order's counts depend on documents only by the set
of filters they fail: one of 2^k masks. A table of masks by orders, built once, tells at which step each mask goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hotkeys import left_join
from millrace.plans.materialize import materialize

#: Bytes that are no start of a character in UTF-8, and all bytes but capitals.
INNER, NO_CAPITAL = bytes(range(0x80, 0xC0)), bytes(b for b in range(256) if not 65 <= b <= 90)
SPECIAL = b"#$%&*|"
#: Parts whose counts a task holds at once; with more, it sends out what it has and starts anew.
PARTS = 256


@cache
def orders(names: str) -> list[str]:
    """All orders of the filters, in ASCII order."""
    return ["".join(p) for p in permutations(sorted(names))]


@cache
def first_failures(names: str) -> np.ndarray:
    """[mask, order] -> the step (from 0) whose filter removes a document that fails the filters of ``mask``; k if none does."""
    k, bit = len(names), {c: i for i, c in enumerate(names)}
    steps = np.array([[bit[c] for c in order] for order in orders(names)])
    fails = (np.arange(1 << k)[:, None, None] >> steps[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), k)


def _text_mask(body: bytes, least_words: int, distinct_percent: int, capital_percent: int) -> int:
    """Bits 0 to 3: too few words, too few distinct ones, too many capitals, a special character."""
    words = body.split()  # at the six ASCII spaces
    points = len(body.translate(None, INNER))
    return (
        (len(words) < least_words)
        | (100 * len(set(words)) < distinct_percent * len(words)) << 1
        | (100 * len(body.translate(None, NO_CAPITAL)) > capital_percent * points) << 2
        | any(c in body for c in SPECIAL) << 3
    )


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: dict[str, Column] | None = None, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> DataFrame:
    """``keep`` columns and ``mask``: the filters that each document's whole text fails, a bit each.

    Bit 0 (A): under ``least_words`` words. 1 (B): distinct words under ``distinct_percent`` of words. 2 (C): capitals A-Z over
    ``capital_percent`` of code points. 3 (D): a character of SPECIAL. 4 (E): the text equals that of any smaller id; texts are
    equal if their SHA-256 are. Null texts are empty, and equal to each other. A document with a null id is no repeat and
    makes none; rows that share an id don't repeat one another. ``keep`` names columns by new names, so any column may clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = {f"k{i}": c for i, c in enumerate((keep or {}).values())}
    source = docs.select(*[c.alias(n) for n, c in kept.items()], F.col(doc_id).alias("id"), F.sha2(body, 256).alias("h"), body.cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [_text_mask(batch.column(batch.num_columns - 1)[i].as_py(), least_words, distinct_percent, capital_percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(masks, pa.int32())], names=[*batch.schema.names[:-1], "mask"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.drop("body").schema)
    rows = materialize(source.mapInArrow(run, f"{fields}mask int"))
    # only texts of several ids matter; the least is found with map-side combine
    repeats = rows.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").drop("high")
    found = left_join(rows, materialize(repeats), ["h"], "n")
    mask = F.col("mask") + F.when(F.col("id") > F.col("low"), 16).otherwise(0)
    return found.select(*[F.col(n).alias(name) for n, name in zip(kept, keep or {}, strict=True)], mask.alias("mask"))


def _partial(batches: Iterator[pa.RecordBatch], names: str, marks: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, mask, label) to (part, cell, n): a task's counts by part. The label has a bit for each of ``marks`` marks.

    Cells: the number of documents; then for each filter those failing it, and failing it only; then for each of none and the
    marks, each order and each step, those removed.
    """
    k, table = len(names), first_failures(names)
    n_orders = table.shape[1]
    width = 1 + 2 * k + (1 + marks) * n_orders * k
    held: dict[str, np.ndarray] = {}
    bits = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1

    def send() -> pa.RecordBatch:
        cells = [np.flatnonzero(x) for x in held.values()]
        part = np.repeat(np.arange(len(held)), [len(c) for c in cells])
        n = np.concatenate([np.zeros(0, np.int64), *[x[c] for x, c in zip(held.values(), cells, strict=True)]])
        out = [pa.array(list(held), pa.string()).take(pa.array(part)), pa.array(np.concatenate([np.zeros(0, np.int64), *cells]).astype(np.int32)), pa.array(n)]
        held.clear()
        return pa.RecordBatch.from_arrays(out, names=["part", "cell", "n"])

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        part, mask, label = coded.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for p, name in enumerate(coded.dictionary.to_pylist()):
            if len(held) >= parts and name not in held:
                yield send()
            mine = part == p
            count = np.bincount(mask[mine] << marks | label[mine], minlength=1 << (k + marks)).reshape(1 << k, 1 << marks)
            sums = held.setdefault(name, np.zeros(width, np.int64))
            by_mask = count.sum(1)
            sums[0] += by_mask.sum()
            sums[1 : 1 + k] += by_mask @ bits
            sums[1 + k : 1 + 2 * k] += by_mask[1 << np.arange(k)]
            cell = np.arange(n_orders) * (k + 1) + table  # [mask, order]
            for m in range(1 + marks):
                weight = by_mask if m == 0 else count[:, (np.arange(1 << marks) >> (m - 1)) & 1 == 1].sum(1)
                at = 1 + 2 * k + m * n_orders * k
                removed = np.bincount(cell.ravel(), np.repeat(weight, n_orders), n_orders * (k + 1)).reshape(n_orders, k + 1)[:, :k]
                sums[at : at + n_orders * k] += removed.astype(np.int64).ravel()
    if held:
        yield send()


def _report(batches: Iterator[pa.RecordBatch], names: str, marks: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (part, cells, counts) to all rows of the audit."""
    k, listed = len(names), orders(names)
    bit = {c: i for i, c in enumerate(names)}
    steps = np.array([[bit[c] for c in order] for order in listed])
    for batch in batches:
        for part, cells, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            sums = np.zeros(1 + 2 * k + (1 + len(marks)) * len(listed) * k, np.int64)
            sums[cells] = counts
            fails, only = sums[1 : 1 + k], sums[1 + k : 1 + 2 * k]
            removed, *lost = sums[1 + 2 * k :].reshape(1 + len(marks), len(listed), k)
            shapley = np.zeros(k, np.int64)
            np.add.at(shapley, steps, removed)
            columns = [sums[0] - removed.cumsum(1), removed, fails[steps] - removed, only[steps], *lost, shapley[steps]]
            n = len(listed) * k
            keys = [pa.array([part] * n, pa.string()), pa.array(np.repeat(listed, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(listed)))]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c.ravel()) for c in columns]], names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *marks, "shapley"])


def interactions(rows: DataFrame, mask: str, part: str, names: str = "ABCDE", marks: dict[str, Column] | None = None) -> DataFrame:
    """One row for each part, order of the filters and step, with counts within the part, zeros included.

    Bit i of ``mask`` says whether a row fails filter ``names[i]``. ``kept`` (after the step), ``removed`` (at it), ``redundant``
    (failing its filter, removed earlier), ``unique_fails`` (failing its filter only), for each of ``marks`` the removed rows
    that have it (null: no), and ``shapley`` (its filter's removed, summed over all orders). Parts are strings, a null part is the
    empty string; repeated rows count each; an empty table has no parts and no rows. Tasks add up their rows, whatever the
    parts' sizes, and send out at most a few thousand counts a part.
    """
    marks = marks or {}
    listed, parts = list(marks), PARTS
    label = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(marks.values())), F.lit(0))
    source = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(mask).cast("int").alias("mask"), label.cast("int").alias("label"))
    counts = source.mapInArrow(lambda it: _partial(it, names, len(listed), parts), "part string, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("c"))  # as many as the audit has counts
    lost = "".join(f", `{m}` long" for m in listed)
    schema = f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long{lost}, shapley long"
    return by_part.select("part", F.col("c.cell"), F.col("c.n")).mapInArrow(lambda it: _report(it, names, listed), schema)


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", quality: str = "quality", toxic: str = "toxic", **limits: int) -> DataFrame:
    """The ``interactions`` of the five filters of ``failures`` over ``docs``, with the good and toxic documents that are lost.

    A document is good or toxic if any row of ``labels`` of its id says 1; ids without labels, null ones and nulls are neither.
    """
    told = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    rows = failures(docs, text, doc_id, keep={"id": F.col(doc_id), "part": F.col(part)}, **limits)
    both = rows.join(told, "id", "left")
    return interactions(both, "mask", "part", marks={"good_lost": F.col("good") == 1, "toxic_lost": F.col("toxic") == 1})
