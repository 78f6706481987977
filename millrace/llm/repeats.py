"""Suffix-array dedup: remove every byte covered by a long enough string that also starts elsewhere in the corpus.

A suffix array of the whole corpus is not needed to find all long repeats. Winnowing picks sparse suffixes: of every ``length``
bytes, the k-gram with the least hash is an anchor, so two equal strings of that length share an anchor at equal offsets. Anchors
are grouped by their hash; occurrences with an equal surrounding context are settled by counting. What is left, anchors whose
contexts differ, forms an enhanced suffix array: the suffixes that start at an anchor, sorted, with the common prefix of
neighbours. A scan with a stack walks its tree of common-prefix intervals. In each interval, members are split by their left
extension: members that agree on enough of it to reach ``length`` are a repeat with all its occurrences, right-maximal by the
interval and left-maximal by how far their left sides agree before they turn diverse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import keeping
from millrace.plans.materialize import materialize, shuffle_parts

#: Bytes of an anchor; bytes of text that are hashed at once (their positions take POS_BITS).
GRAM, POS_BITS = 64, 22
PIECE = 1 << 21
_SEED2 = xxhash.xxh64_intdigest(b"b", 42)
SPAN = "k1 long, k2 long, start long, end long"


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text; equal texts are one text from here on."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("b"), text).alias("k2")]


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: in each window of ``length`` bytes, the first k-gram of least hash."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    base, step = 0x9E3779B97F4A7C15, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base & (1 << 64) - 1, step * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << POS_BITS) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    window, done = length - GRAM + 1, 1
    while done < window:
        step = min(done, window - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    at = (m & low).astype(np.int64)
    at = np.unique(at[np.concatenate([[True], at[1:] != at[:-1]])])
    return at, h[at]


def _all_anchors(blob: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a whole text, piece by piece; pieces overlap so that no window is lost."""
    data = np.frombuffer(blob, np.uint8)
    if len(data) <= PIECE:
        return anchors(data, length)
    found = [(a + s, h) for s in range(0, len(data) - length + 1, PIECE - length + 1) for a, h in [anchors(data[s : s + PIECE], length)]]
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, sorted and disjoint; touching ones become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: anchor h, ctx, text, pos, many; kind 1: span from pos to h). Occurrences of one context within a batch are
    settled here and leave it once, so what is frequent everywhere is shuffled once for each batch."""
    left, digest = length - GRAM, xxhash.xxh64_intdigest
    for batch in batches:
        k1s, k2s, texts = (batch.column(i) for i in range(3))
        seen: set[tuple[int, int]] = set()
        keys, rows, at, hs, ctx = [], [], [], [], []
        for i in range(batch.num_rows):
            key = (k1s[i].as_py(), k2s[i].as_py())
            if key in seen:
                continue
            seen.add(key)
            blob = texts[i].as_py().encode("utf-8", "surrogatepass")
            a, h = _all_anchors(blob, length)
            if not len(a):
                continue
            rows.append(np.full(len(a), len(keys)))
            keys.append(key)
            at.append(a)
            hs.append(h)
            ctx.append(np.array([digest(blob[max(0, p - left) : p + length], min(p, left)) for p in a.tolist()], np.uint64))
        if not keys:
            continue
        row, pos, h, c = (np.concatenate(x) for x in (rows, at, hs, ctx))
        order = np.lexsort((c, h))
        row, pos, h, c = row[order], pos[order], h[order], c[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        many = np.concatenate([~first[1:], [False]])[first]
        k1, k2 = (np.array(x, np.int64) for x in zip(*keys, strict=True))

        def out(kind: int, row: np.ndarray, a: np.ndarray, b: np.ndarray, pos: np.ndarray, many: np.ndarray, k1=k1, k2=k2) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, np.int32)), pa.array(a), pa.array(b), pa.array(k1[row]), pa.array(k2[row]), pa.array(pos), pa.array(many)], names=["kind", "h", "ctx", "k1", "k2", "pos", "many"])

        f = np.flatnonzero(first)
        yield out(0, row[f], h[f].view(np.int64), c[f].view(np.int64), pos[f], many)
        rest = np.flatnonzero(~first)
        if len(rest):
            order = rest[np.lexsort((pos[rest], row[rest]))]
            r, s = row[order], np.maximum(pos[order] - left, 0)
            # one text's spans that touch become one: shift each text's positions past those of the text before
            shift = r * np.int64(1 << 40)
            s, e = _merge(s + shift, pos[order] + length + shift)
            r = s >> 40
            yield out(1, r, e - (r << 40), np.zeros(len(r), np.int64), s - (r << 40), np.zeros(len(r), bool))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray | pa.Array]]:
    """Columns of whole runs of the first column, over batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        held.append(batch)
        if key[0] == key[-1]:
            continue
        table = pa.Table.from_batches(held)
        cut = len(table) - int((key == key[-1]).sum())
        held = table.slice(cut).combine_chunks().to_batches()
        yield {c: table.slice(0, cut).column(c).combine_chunks() for c in table.column_names}
    if held:
        table = pa.Table.from_batches(held)
        yield {c: table.column(c).combine_chunks() for c in table.column_names}


def _count(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by (h, ctx, text, pos). Out, kind 1: spans of contexts that occur again; kind 0: one occurrence of each
    context of an anchor that has several, if any of them occurs but once; ``many`` tells which don't."""
    left = length - GRAM
    for cols in _runs(batches):
        h, ctx, k1, k2, pos, many = (cols[c].to_numpy(zero_copy_only=False) for c in ("h", "ctx", "k1", "k2", "pos", "many"))
        same_h, same_c = h[1:] == h[:-1], ctx[1:] == ctx[:-1]
        # a text met in several tasks gives equal rows
        new = np.concatenate([[True], ~(same_h & same_c & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (pos[1:] == pos[:-1]))])
        group = np.cumsum(np.concatenate([[True], ~(same_h & same_c)])) - 1
        count = np.bincount(group, new.astype(float) + many)
        run = np.cumsum(np.concatenate([[True], ~same_h])) - 1
        firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        contexts = np.bincount(run[firsts])
        single = np.bincount(run[firsts], count < 2)
        full = np.flatnonzero(new & (count[group] >= 2))
        open_ = firsts[((contexts >= 2) & (single >= 1))[run[firsts]]]
        for kind, i, end in ((1, full, pos[full] + length), (0, open_, h[open_])):
            at = np.maximum(pos[i] - left, 0) if kind else pos[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(end), pa.array(k1[i]), pa.array(k2[i]), pa.array(at), pa.array(count[group[i]] >= 2)], names=["kind", "h", "k1", "k2", "pos", "many"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, text, wanted) to rows (h, suffix, before, k1, k2, pos, many): a suffix and what stands before it, reversed."""
    left = length - GRAM
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            k1, k2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            blob = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
            for w in batch.column(3)[i].as_py():
                p = w["pos"]
                out.append((w["h"], blob[p : p + length], blob[max(0, p - left) : p][::-1], k1, k2, p, w["many"]))
            if len(out) > 20_000:
                yield _context_batch(out)
                out = []
        yield _context_batch(out)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=["h", "suffix", "before", "k1", "k2", "pos", "many"])


def _matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of equal width, and their lengths."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(1, np.uint8)
    n = np.diff(offsets)
    at = offsets[:-1, None] + np.arange(width)
    inside = np.arange(width) < n[:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0), n


def _common(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j."""
    differ = m[i] != m[j]
    first = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return np.minimum(first, np.minimum(n[i], n[j]))


def interval_tree(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, common) of every common-prefix interval of a sorted run of suffixes; lcp[i] is that of suffixes i and i+1."""
    stack: list[tuple[int, int]] = []  # first suffix, common prefix
    for i, value in enumerate([*lcp, -1]):
        low = i
        while stack and stack[-1][1] > value:
            low, common = stack.pop()
            if common >= least:
                yield low, i + 1, common
        if value >= 0 and (not stack or stack[-1][1] < value):
            stack.append((low, value))


def _repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by (h, suffix) to the spans of all occurrences of their repeats."""
    for cols in _runs(batches):
        # a text that came from two batches is one: its equal rows stand side by side
        ids = [cols[c].to_numpy() for c in ("h", "k1", "k2", "pos")]
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ids], axis=0)])
        if not new.all():
            cols = {c: v.take(pa.array(np.flatnonzero(new))) for c, v in cols.items()}
        h = cols["h"].to_numpy()
        suffix, n_suffix = _matrix(cols["suffix"], length)
        before, n_before = _matrix(cols["before"], length - GRAM)
        n = len(h)
        i = np.arange(n - 1)
        lcp = np.where(h[1:] == h[:-1], _common(suffix, n_suffix, i, i + 1), 0)
        go_left, go_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        size = np.diff(bounds)
        # runs of two have one interval: all of them at once
        two = bounds[:-1][size == 2]
        if len(two):
            l_, r_ = _common(before, n_before, two, two + 1), lcp[two]
            hit = l_ + r_ >= length
            for k in (0, 1):
                go_left[two[hit] + k], go_right[two[hit] + k] = l_[hit], r_[hit]
        for b, s in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            # order by the left side once; members of any interval keep it
            rank = np.empty(s, np.int64)
            by_left = np.lexsort(before[b : b + s].T[::-1])
            rank[by_left] = np.arange(s)
            for low, high, common in interval_tree(lcp[b : b + s - 1].tolist(), GRAM):
                need = length - common
                members = by_left[np.sort(rank[low:high])] + b
                shared = _common(before, n_before, members[:-1], members[1:])
                close = shared >= need  # neighbours whose left sides agree far enough: one repeat
                if not close.any():
                    continue
                best = np.maximum(np.concatenate([np.where(close, shared, -1), [-1]]), np.concatenate([[-1], np.where(close, shared, -1)]))
                in_ = best >= 0
                go_left[members[in_]] = np.maximum(go_left[members[in_]], best[in_])
                go_right[members[in_]] = np.maximum(go_right[members[in_]], common)
        hit = np.flatnonzero(go_right)
        pos = cols["pos"].to_numpy()[hit]
        yield pa.RecordBatch.from_arrays([pa.array(cols["k1"].to_numpy()[hit]), pa.array(cols["k2"].to_numpy()[hit]), pa.array(pos - go_left[hit]), pa.array(pos + go_right[hit])], names=["k1", "k2", "start", "end"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each text in a batch: copies are not shuffled."""
    for batch in batches:
        seen: set[tuple[int, int]] = set()
        keep = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())) if len(keep) < batch.num_rows else batch


def _cut(batches: Iterator[pa.RecordBatch], whole_from: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, text, spans, whole) to what is removed and what is kept of each text."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            blob = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
            if batch.column(4)[i].as_py() and len(blob) >= whole_from:
                s, e = np.array([0]), np.array([len(blob)])
            else:
                spans = batch.column(3)[i].as_py() or []
                s, e = _merge(np.array([x["start"] for x in spans], np.int64), np.minimum(np.array([x["end"] for x in spans], np.int64), len(blob)))
            kept, at = hashlib.sha256(), 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                kept.update(blob[at:a])
                at = b
            kept.update(blob[at:])
            rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(blob), int((e - s).sum()), len(s), kept.hexdigest(), [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


@keeping("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``removed`` (structs start, end in bytes).

    Removed is every UTF-8 byte covered by a ``length``-byte string that also starts anywhere else, in the same text or another;
    strings are judged on the input. Null text is empty. Texts shorter than ``length`` lose nothing; repeated rows of a long
    enough text lose all of it. Texts may be of any length; spans are the maximal removed runs.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    keep = docs.columns if keep is None else keep
    names = [f"{prefix}{x}" for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    parts = shuffle_parts(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(*text_key(body), body.alias("text"))
    long = texts.where(F.octet_length("text") >= length)

    scanned = materialize(long.mapInArrow(lambda it: _scan(it, length), "kind int, h long, ctx long, k1 long, k2 long, pos long, many boolean"))
    sorted_ = scanned.where("kind = 0").select("h", "ctx", "k1", "k2", "pos", "many").repartition(parts, "h").sortWithinPartitions("h", "ctx", "k1", "k2", "pos")
    counted = materialize(sorted_.mapInArrow(lambda it: _count(it, length), "kind int, h long, k1 long, k2 long, pos long, many boolean"))

    wanted = counted.where("kind = 0").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "pos", "many")).alias("wanted"))
    contexts = long.mapInArrow(_once, long.schema).join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted")
    contexts = contexts.mapInArrow(lambda it: _contexts(it, length), "h long, suffix binary, before binary, k1 long, k2 long, pos long, many boolean")
    suffixes = contexts.repartition(parts, "h").sortWithinPartitions("h", "suffix", "k1", "k2", "pos")
    repeats = suffixes.mapInArrow(lambda it: _repeats(it, length), SPAN)

    settled = [t.where("kind = 1").select("k1", "k2", F.col("pos").alias("start"), F.col("h").alias("end")) for t in (scanned, counted)]
    spans = settled[0].union(settled[1]).union(repeats)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.select(*keep, *[k.alias(f"__{n}") for k, n in zip(text_key(body), ("k1", "k2"), strict=True)])
    copies = texts.groupBy("k1", "k2").agg((F.count(F.lit(1)) > 1).alias("whole"))
    once = texts.mapInArrow(_once, texts.schema)
    cut = once.join(spans, ["k1", "k2"], "left").join(copies, ["k1", "k2"]).select("k1", "k2", "text", "spans", "whole")
    span = "array<struct<start:bigint,end:bigint>>"
    cut = cut.mapInArrow(lambda it: _cut(it, length), f"k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed {span}")
    cut = materialize(cut.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), *[F.col(n.removeprefix(prefix)).alias(n) for n in names]).dropDuplicates(["__k1", "__k2"]))
    return rows.join(cut, ["__k1", "__k2"]).select(*keep, *names)
