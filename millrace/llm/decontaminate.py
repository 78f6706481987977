"""Benchmark decontamination: a BM25 inverted index of the test items, block-max pruning, and overlap checks of what is found.

Every passage of every training document is a query. Impacts are BM25 contributions divided by the item's score for itself, so a
score is between 0 and 1 and one threshold fits all items. Each posting list is cut into blocks of items with the block's highest
impact; the sum of these over a passage's terms bounds the score of every item of a block, and only blocks whose bound reaches
the threshold are live. Bounds are taken for many passages at a time, as arrays; a passage with live blocks is then walked by WAND:
its terms' cursors are kept in the order of items, the pivot is the first item that the highest impacts up to it can lift to the
threshold, and cursors before it skip to it, or past the block where even the blocks' impacts can't. No item above the threshold is
missed.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import keeping
from millrace.llm.textbatch import pieces, trimmed
from millrace.plans.materialize import materialize

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Words of a passage; the next starts half of it later, so a run of half as many words lies whole in some passage.
PASSAGE = 128
#: Longer items are indexed in parts of this many words.
PART = PASSAGE // 2
#: Items of a block of a posting list; words of test items in one index, the bound of what is broadcast (about 100 bytes a word).
BLOCK, INDEX_WORDS = 8, 500_000
SHINGLE = 5


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Index:
    """Postings of term t: ``post_part[post_at[t]:post_at[t+1]]`` with ``post_impact``; its blocks likewise; ``most`` its highest impact.

    ``part_item``: item of each part; ``overlap``: for each item ``overlap_hashes`` of its words' term numbers."""

    terms: dict[str, int]
    part_item: np.ndarray
    overlap: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    ids: pa.Array
    post_at: np.ndarray
    post_part: np.ndarray
    post_impact: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    most: np.ndarray


def shingles(words: list[str], width: int = SHINGLE) -> frozenset:
    """All runs of ``width`` words; of fewer words, the whole run."""
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def overlap_sets(words: list[str]) -> tuple[int, frozenset, frozenset, frozenset]:
    """Width, and shingles of an item, of those that touch its question, of those that touch its answer.

    Items have one text column: the last third is the answer, what comes before is the question. An item of fewer words than
    a shingle has one, of its own length.
    """
    width = max(1, min(SHINGLE, len(words)))
    cut = len(words) - len(words) // 3
    runs = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    return width, frozenset(runs), frozenset(runs[:cut]), frozenset(runs[max(0, cut - width + 1) :])


def run_hashes(terms: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` term numbers; 0 where one is unknown (-1)."""
    n = max(0, len(terms) - width + 1)
    h, ok = np.full(n, width, np.uint64), np.ones(n, bool)
    for j in range(width):
        t = terms[j : j + n]
        h = (h ^ (t + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ok &= t >= 0
    return np.where(ok, h | np.uint64(1), np.uint64(0))


def overlap_hashes(terms: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """``overlap_sets`` of an item given as term numbers, each set as sorted hashes."""
    width = max(1, min(SHINGLE, len(terms)))
    cut = len(terms) - len(terms) // 3
    h = run_hashes(terms, width)
    return width, np.unique(h), np.unique(h[:cut]), np.unique(h[max(0, cut - width + 1) :])


def _parts(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in items:
        rows, parts, words = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            found = words_of(text)
            for k, at in enumerate(range(0, max(1, len(found)), PART)):
                piece = found[at : at + PART]
                if len(piece) >= min(SHINGLE, len(found)) and piece:
                    rows.append(i)
                    parts.append(k)
                    words.append(piece)
        of = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*of, pa.array(parts, pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["item", "id", "part", "words"])


def build_indexes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Index]:
    """Indexes of the test items, each of at most about INDEX_WORDS words; document frequencies are those of all items.

    Every row is an item of its own, whatever its id: repeated rows and null ids are not run together.
    """
    kind = items.schema[item_id].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("id"), F.col(text).alias("t"))
    parts = materialize(numbered.mapInArrow(trimmed(_parts), f"item long, id {kind}, part int, words array<string>"))
    n, total = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not n:
        return []
    df = materialize(parts.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    count = -(-total // INDEX_WORDS)
    indexes = []
    for k in range(count):
        mine = parts.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k)
        table = mine.toArrow().sort_by([("item", "ascending"), ("part", "ascending")])  # about INDEX_WORDS words
        freq = dict(df.join(mine.select(F.explode("words").alias("term")).distinct(), "term", "left_semi").collect())
        if len(table):
            indexes.append(_index(table.select(["item", "part", "words"]).to_pylist(), freq, n, total / n, table.column("id").combine_chunks()))
    return indexes


def _index(rows: list[dict], freq: dict[str, int], n: int, mean: float, ids: pa.Array | None = None) -> Index:
    """Index of parts, the parts of an item side by side; ``ids`` has the item's id at each part."""
    terms = {t: i for i, t in enumerate(sorted(freq))}
    numbers: dict[int, int] = {}
    words: list[list[int]] = []
    first, part_item, entries = [], [], []
    for p, r in enumerate(rows):
        j = numbers.setdefault(r["item"], len(numbers))
        if j == len(words):
            words.append([])
            first.append(p)
        words[j] += [terms[w] for w in r["words"]]
        part_item.append(j)
        tf: dict[str, int] = {}
        for w in r["words"]:
            tf[w] = tf.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(r["words"]) / mean)
        score = {w: np.log1p((n - freq[w] + 0.5) / (freq[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
        own = sum(score.values())
        entries += [(terms[w], p, s / own) for w, s in score.items()]
    entries.sort()
    term, part, impact = (np.array(x) for x in zip(*entries, strict=True))
    key = term.astype(np.int64) * (len(rows) // BLOCK + 1) + part // BLOCK
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    post_at = np.searchsorted(term, np.arange(len(terms) + 1))
    overlap = [overlap_hashes(np.array(w, np.int64)) for w in words]
    ids = pa.array(list(numbers)) if ids is None else ids.take(pa.array(first, pa.int64()))
    return Index(
        terms, np.array(part_item), overlap, ids, post_at, part, impact,
        np.searchsorted(term[edge], np.arange(len(terms) + 1)), part[edge] // BLOCK, np.maximum.reduceat(impact, edge), np.maximum.reduceat(impact, post_at[:-1]),
    )


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start[i] to end[i]-1 of every i, and the i of each."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of], of


def _live(index: Index, tokens: np.ndarray, text: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(passage, its terms, its live blocks); a passage is half a stride of a text, see ``matches``."""
    n_blocks, n_passages = len(index.part_item) // BLOCK + 1, len(first)
    known = np.flatnonzero(tokens >= 0)
    # token i of a text lies in the passages that start at its own half-passage and at the one before
    passage = np.concatenate([text[known], text[known] - 1])
    ok = np.concatenate([np.ones(len(known), bool), text[known] > first[text[known]]])
    pair = np.unique(passage[ok] * np.int64(len(index.terms)) + np.concatenate([tokens[known]] * 2)[ok])
    passage, term = pair // len(index.terms), pair % len(index.terms)
    # the highest impacts of a passage's terms must reach the threshold at all
    enough = np.bincount(passage, index.most[term], n_passages) >= threshold - 1e-9
    passage, term = passage[enough[passage]], term[enough[passage]]
    step = max(1, 4_000_000 // n_blocks)
    for low in range(0, n_passages, step):
        a, b = np.searchsorted(passage, [low, low + step])
        p, t = passage[a:b] - low, term[a:b]
        at, of = _ranges(index.block_at[t], index.block_at[t + 1])
        bound = np.bincount(p[of] * n_blocks + index.block[at], index.block_impact[at], min(step, n_passages - low) * n_blocks)
        live = (bound >= threshold - 1e-9).reshape(-1, n_blocks)
        for i in np.flatnonzero(live.any(1)).tolist():
            x, y = np.searchsorted(p, [i, i + 1])
            yield i + low, t[x:y], np.flatnonzero(live[i])


def wand(index: Index, terms: np.ndarray, live: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
    """(part, score) of all parts in the live blocks at the threshold or above.

    Cursors stand in a heap by part. In each round the pivot is found; if the impacts of the blocks it lies in reach the threshold too,
    the cursors before it are moved to it, and once they all stand there it is scored. Else all up to the pivot skip to
    where the first of these blocks ends. Parts outside the live blocks are left out of the lists beforehand.
    """
    threshold -= 1e-9
    at, of = _ranges(index.post_at[terms], index.post_at[terms + 1])
    inside = np.isin(index.post_part[at] // BLOCK, live)
    at, of = at[inside], of[inside]
    parts, impacts = index.post_part[at].tolist(), index.post_impact[at].tolist()
    ends = np.searchsorted(of, np.arange(len(terms)), "right").tolist()
    most = index.most[terms].tolist()
    at, of = _ranges(index.block_at[terms], index.block_at[terms + 1])
    inside = np.isin(index.block[at], live)
    blocks = dict(zip(zip(of[inside].tolist(), index.block[at[inside]].tolist(), strict=True), index.block_impact[at[inside]].tolist(), strict=True))
    heap = [(parts[a], t, a) for t, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]  # part, term, position
    heapq.heapify(heap)

    def skip(cursors: list[tuple[int, int, int]], part: int) -> None:
        for _, t, a in cursors:
            a = bisect_left(parts, part, a, ends[t])
            if a < ends[t]:
                heapq.heappush(heap, (parts[a], t, a))

    while heap:
        before, reach = [], 0.0
        while heap and reach < threshold:
            before.append(heapq.heappop(heap))
            reach += most[before[-1][1]]
        if reach < threshold:
            return
        pivot = before[-1][0]
        while heap and heap[0][0] == pivot:
            before.append(heapq.heappop(heap))
        block = pivot // BLOCK
        if sum(blocks.get((t, block), 0.0) for _, t, _ in before) < threshold:
            # no part of this block before the next cursor can do
            skip(before, min((block + 1) * BLOCK, heap[0][0] if heap else (block + 1) * BLOCK))
        elif before[0][0] < pivot:
            skip(before, pivot)
        else:
            score = sum(impacts[a] for _, _, a in before)
            if score >= threshold:
                yield pivot, score
            skip(before, pivot + 1)


def matches(index: Index, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(text, item, score, overlaps with the item, its question, its answer) of all passages and parts at the threshold or above."""
    get = index.terms.get
    lists = [words_of(t) for t in texts]
    half = PASSAGE // 2
    tokens = np.array([get(w, -1) for ws in lists for w in ws], np.int64)
    lengths = np.array([len(ws) for ws in lists], np.int64)
    # passages are numbered through all texts, one for each half-passage that a text begins
    count = np.maximum(1, -(-lengths // half))
    base = np.concatenate([[0], np.cumsum(count)])
    of_text = np.repeat(np.arange(len(lists)), lengths)
    number = base[of_text] + (np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // half
    start = np.repeat(base[:-1], count)
    owner = np.repeat(np.arange(len(lists)), count)
    hashes: dict[int, np.ndarray] = {}
    begin = np.concatenate([[0], np.cumsum(lengths)])
    for p, terms, live in _live(index, tokens, number, start, threshold):
        i = int(owner[p])
        at = (p - int(start[p])) * half
        for part, score in wand(index, terms, live, threshold):
            item = int(index.part_item[part])
            # an item in parts may go on before and after the passage
            width, *sets = index.overlap[item]
            margin = len(sets[0]) + 2 * SHINGLE
            if width not in hashes:
                hashes[width] = run_hashes(tokens, width)
            a, b = begin[i] + max(0, at - margin), min(begin[i + 1], begin[i] + at + PASSAGE + margin)
            seen = hashes[width][a : max(a, b - width + 1)]
            yield i, item, score, *(float(np.isin(s, seen).mean()) if len(s) else 1.0 for s in sets)


def _verified(whole: float, question: float, answer: float, similarity: float) -> bool:
    return whole >= similarity and question > 0 and answer > 0


FOUND = ("item_id", "score", "overlap", "question_overlap", "answer_overlap", "n_passages")


@keeping(*FOUND)
def contaminated_pairs(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, similarity: float = 0.8, prefix: str = "") -> DataFrame:
    """One row for each row of ``docs`` and row of ``items`` verified in it: ``keep``, ``item_id``, ``score``, overlaps, ``n_passages``.

    Verified: at least ``similarity`` of the item's five-word shingles stand in the passage or right beside it, some of its
    question and some of its answer among them. Null and empty texts match nothing; items without words are never matched; repeated
    rows of items each match, and so do rows whose id is null. New columns are named with ``prefix``. Tables of documents are read
    once for each index of INDEX_WORDS words of test items; no document is shuffled.
    """
    out = None
    names = [f"{prefix}{x}" for x in FOUND]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    kind = items.schema[item_id].dataType.simpleString()
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.drop("__text").schema)
    schema = fields + ", ".join(f"`{n}` {t}" for n, t in zip(names, (kind, *["double"] * 4, "int"), strict=True))
    indexes = build_indexes(items, item_id, item_text)
    if not indexes:
        return source.drop("__text").limit(0).select("*", *[F.lit(None).cast(t).alias(n) for n, t in zip(names, (kind, *["double"] * 4, "int"), strict=True)])
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most about INDEX_WORDS words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rest = pa.RecordBatch.from_arrays([batch.column(i) for i, x in enumerate(batch.schema.names) if x != "__text"], names=[x for x in batch.schema.names if x != "__text"])
                rows, found = [], []
                for first, texts in pieces(batch, "__text"):
                    best: dict[tuple[int, int], list] = {}
                    for i, item, *values in matches(shared.value, texts, threshold):
                        if _verified(*values[1:], similarity):
                            old = best.setdefault((i, item), [0.0] * 4 + [0])
                            old[:] = [*map(max, old, values), old[4] + 1]
                    for (i, item), values in sorted(best.items()):
                        rows.append(first + i)
                        found.append((item, *values))
                taken = rest.take(pa.array(rows, pa.int64()))
                columns = list(zip(*found, strict=True)) or [()] * 6
                numbers = pa.array(columns[0], pa.int64())
                ids = shared.value.ids.take(numbers)
                values = (pa.array(c, t) for c, t in zip(columns[1:], (*[pa.float64()] * 4, pa.int32()), strict=True))
                yield pa.RecordBatch.from_arrays([*taken.columns, ids, *values], names=[*taken.schema.names, *names])

        part = source.mapInArrow(trimmed(run), schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` in which no test item is verified, with all their columns; nothing is shuffled."""
    for index in build_indexes(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        where = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, where=where) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for first, texts in pieces(batch, batch.schema.names[where]):
                    for i, _, _, *overlaps in matches(shared.value, texts, threshold):
                        bad[first + i] |= _verified(*overlaps, similarity)
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
