"""Language identification with bit-sliced Bloom filters of character n-grams.

Fitting counts n-grams by language over a bounded sample of labelled rows and inserts each characteristic n-gram of a language
into that language's Bloom filter. The filters are stored sliced: one array whose entry p holds, as bits, the languages whose
filter has position p set. One probe of an n-gram (an AND of a few entries) so returns every language that contains it. A text
is decided by popcounts: the number of its n-grams found for each language, corrected for the filters' false positives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import keeping
from millrace.llm.textbatch import pieces, trimmed

_ASCII_LETTER = re.compile("[A-Za-z]")
PIECE = 250_000  # characters whose n-grams a task holds at once
UNDETERMINED = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass(frozen=True)
class LangModel:
    """``slices[p, w]``: languages 64w to 64w+63 whose filter has position p set; ``false_rate[l]``: chance that language l is
    returned for an n-gram that was not inserted."""

    languages: tuple[str, ...]
    slices: np.ndarray
    probes: int
    orders: tuple[int, ...]
    false_rate: np.ndarray


def _grams(texts: list[str | None], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased texts, each n-gram within a word padded by one space, and the text of each."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\x00".join(lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # each text with the mark after it, by length: a text may hold U+0000 itself
    row = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])[: len(points)]
    # letters keep their code; all else is a word boundary. Above ASCII everything but spaces and punctuation counts as a letter.
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xAA) & ~((points >= 0x2000) & (points <= 0x206F)) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0xAB) & (points <= 0xB4)) & ~((points >= 0xB6) & (points <= 0xB9)) & ~((points >= 0xBB) & (points <= 0xBF)))
    code = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    hashes, rows = [], []
    for n in orders:
        if len(code) < n:
            continue
        h = np.zeros(len(code) - n + 1, np.uint64)
        inner = np.zeros(len(h), np.int32)
        for j in range(n):
            h = (h ^ code[j : len(h) + j]) * _MIX[0]
            h ^= h >> np.uint64(29)
            inner += letter[j : len(h) + j]
        # whole inside one word, or with a boundary at one end only
        ok = inner == n
        ok |= (inner == n - 1) & (~letter[: len(h)] | ~letter[n - 1 :][: len(h)]) if n > 2 else (inner == n - 1)
        ok &= row[: len(h)] == row[n - 1 :][: len(h)]
        hashes.append(h[ok] + np.uint64(n))
        rows.append(row[: len(h)][ok])
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _positions(h: np.ndarray, j: int, size: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * _MIX[j + 1]
    return ((x >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)


def fit(
    docs: DataFrame,
    train: Column,
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 20_000,
    sample_bytes: int = 100_000_000,
    doc_id: str | None = "doc_id",
    orders: tuple[int, ...] = (2, 3, 4),
    least_count: int = 5,
    share: float = 0.5,
    log2_positions: int = 20,
    probes: int = 3,
) -> LangModel:
    """Fit on the rows where ``train`` holds and ``lang`` is not null.

    ``sample_rows`` and ``sample_bytes`` bound the rows and their UTF-8 bytes in expectation: each qualifying row is taken with the
    probability that meets both, decided by a hash of its text and of ``doc_id`` (if given), so the fit costs the same at any
    corpus size and copies of one text are taken apart. An n-gram is inserted for language l if l has it
    ``least_count`` times or more and at a rate of at least ``share`` of the highest rate of any language.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    share_taken = min(1.0, sample_rows / max(n, 1), sample_bytes / max(size, 1))
    if share_taken < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("fit"), *[text, *([doc_id] if doc_id else [])]), F.lit(1 << 40)) < F.lit(int((1 << 40) * share_taken)))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in pieces(batch, "text", PIECE):
                h, row = _grams(texts, orders)
                names = sorted({*langs[first : first + len(texts)]})
                index = np.array([names.index(x) for x in langs[first : first + len(texts)]])[row]
                for k, name in enumerate(names):
                    grams, counts = np.unique(h[index == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    counted = rows.mapInArrow(trimmed(count), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= 2)
    # bounded by the sample: its rows' distinct n-grams
    found = counted.toArrow()
    languages = tuple(sorted({*found.column("lang").to_pylist()}))
    index = {x: i for i, x in enumerate(languages)}
    size, words = 1 << log2_positions, max(1, (len(languages) + 63) // 64)
    slices = np.zeros((size, words), np.uint64)
    fill = np.zeros(len(languages))
    if languages:
        gram = found.column("gram").to_numpy().view(np.uint64)
        of = np.array([index[x] for x in found.column("lang").to_pylist()])
        count_ = found.column("n").to_numpy()
        total = np.bincount(of, count_, len(languages))
        rate = count_ / total[of]
        unique, at = np.unique(gram, return_inverse=True)
        best = np.zeros(len(unique))
        np.maximum.at(best, at, rate)
        keep = (count_ >= least_count) & (rate >= share * best[at])
        for k in range(len(languages)):
            mine = gram[keep & (of == k)]
            for j in range(probes):
                p = np.unique(_positions(mine, j, size))
                slices[p, k // 64] |= np.uint64(1 << (k % 64))
            fill[k] = np.mean(slices[:, k // 64] >> np.uint64(k % 64) & np.uint64(1))
    return LangModel(languages, slices, probes, tuple(orders), fill**probes)


def _decide(model: LangModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    langs, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return langs, score
    h, row = _grams(texts, model.orders)
    size = len(model.slices)
    mask = model.slices[_positions(h, 0, size)]
    for j in range(1, model.probes):
        mask = mask & model.slices[_positions(h, j, size)]
    n = np.bincount(row, minlength=len(texts)).astype(float)
    hits = np.empty((len(texts), len(model.languages)))
    for k in range(len(model.languages)):
        set_ = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        hits[:, k] = np.bincount(row, set_, len(texts))
    # of n n-grams, about false_rate of those not inserted are returned all the same
    true = np.clip((hits - n[:, None] * model.false_rate) / (1 - model.false_rate), 0, None)
    best = true.argmax(1)
    share = true[np.arange(len(texts)), best] / np.maximum(true.sum(1), 1e-12)
    for i, t in enumerate(texts):
        if t is not None and has_letter(t):
            langs[i] = model.languages[best[i]]
            score[i] = min(1.0, max(0.0, share[i]))
    return langs, score


@keeping("lang_pred", "score")
def identify(docs: DataFrame, model: LangModel, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1: the share of the decided language among all n-grams found).

    ``und`` with score 0: the text is null, has no letter, or the model knows no language. Ties go to the language first in
    alphabetical order, so a text whose n-grams are all unknown gets that one with score 0. Whole texts are read; repeated rows
    are decided alike; an empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    names = [f"{prefix}lang_pred", f"{prefix}score"]
    if clash := {*names} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size fixed by log2_positions and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, texts in pieces(batch, "__text", PIECE):
                a, b = _decide(shared.value, texts)
                langs += a
                scores.append(b)
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*[x for x in batch.schema.names if x != "__text"], *names])

    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema)
    return source.mapInArrow(trimmed(run), f"{fields}{', ' * bool(fields)}`{names[0]}` string, `{names[1]}` double")
