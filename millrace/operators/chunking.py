"""Chunkers: fixed, recursive, hierarchical, semantic, by separators and by Markdown blocks.

A chunker is a function of one text; ``chunk`` applies it to a table. Long texts are independent rows, so a skewed table is
repartitioned before the kernel, not inside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.textmap import flat_map_text

# Defaults and bounds.
SIZE, OVERLAP = 800, 100
PARENT_SIZE, CHILD_SIZE, CHILD_OVERLAP = 1024, 256, 51
SEMANTIC_THRESHOLD, MIN_SIZE, MAX_SIZE = 0.85, 50, 2000
SENTENCE = re.compile(r"[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+$")
LATIN = re.compile(r"[A-Za-z]")


@dataclass(frozen=True)
class ChunkConfig:
    size: int = SIZE
    overlap: int = OVERLAP
    preserve_newlines: bool = True
    separators: tuple[str, ...] = ()

    def __post_init__(self):
        if self.size < 1 or self.overlap < 0 or self.overlap > self.size // 2:
            raise ValueError("size must be positive and the overlap at most half of it")


def sentences(text: str) -> list[str]:
    return [s for m in SENTENCE.finditer(text) if (s := m[0].strip())]


def _whole_word_end(text: str, end: int, most: int) -> int:
    """Move a cut inside a Latin word to the word's start, or else to its end, by ``most`` characters at most."""
    if not (LATIN.match(text[end - 1]) and LATIN.match(text[end])):
        return end
    word = re.search(r"[A-Za-z]+$", text[max(0, end - most - 1) : end])
    if word and end - len(word[0]) > 0 and len(word[0]) <= most:
        return end - len(word[0])
    rest = re.match(r"[A-Za-z]+", text[end : end + most + 1])
    return end + len(rest[0]) if rest and len(rest[0]) <= most and end + len(rest[0]) < len(text) else end


def fixed(text: str, config: ChunkConfig) -> list[str]:
    """Windows of ``size`` characters; a window's end keeps Latin words whole, the next starts ``overlap`` before it."""
    text, start, out = text.strip(), 0, []
    while start < len(text):
        end = min(len(text), start + config.size)
        if end < len(text):
            end = max(_whole_word_end(text, end, max(1, int(config.size * 0.3))), start + 1)
        piece = text[start:end] if config.preserve_newlines else " ".join(text[start:end].splitlines())
        if piece.strip():
            out.append(piece.strip())
        start = max(start + 1, end - config.overlap) if end < len(text) else end
    return out


def _pieces(text: str, config: ChunkConfig) -> Iterable[tuple[str, str]]:
    """(joiner, piece): paragraphs that fit, else their sentences, else their words."""
    parts = [text.strip()]
    if config.separators:
        for sep in filter(None, config.separators):
            parts = [x for p in parts for x in p.split(sep)]
    else:
        parts = re.split(r"\n\s*\n", parts[0])
    for part in filter(None, map(str.strip, parts)):
        if len(part) <= config.size:
            yield "\n\n", part
            continue
        yield "", ""  # a long paragraph starts a chunk of its own
        for sentence in sentences(part):
            for unit in [sentence] if len(sentence) <= config.size else sentence.split():
                yield " ", unit


def _tail(text: str, overlap: int) -> str:
    """Last characters of a chunk, from the start of a word."""
    tail = text[-overlap:]
    if len(text) > overlap and LATIN.match(text[-overlap - 1]) and LATIN.match(tail[0]):
        tail = tail.partition(" ")[2]
    return tail.strip()


def recursive(text: str, config: ChunkConfig) -> list[str]:
    """Pack paragraphs, sentences or words greedily into ``size`` characters; then prefix each chunk with the end of the last."""
    out, current = [], ""
    for joiner, piece in _pieces(text, config):
        if current and (not joiner or len(current) + len(joiner) + len(piece) > config.size):
            out.append(current)
            current = piece
        else:
            current = f"{current}{joiner}{piece}" if current else piece
    if current:
        out.append(current)
    if not config.overlap:
        return out
    return out[:1] + [f"{_tail(a, config.overlap)} {b}".strip() for a, b in zip(out, out[1:], strict=False)]


def markdown_blocks(text: str) -> list[tuple[str, bool]]:
    """(block, atomic): front matter, fences and tables are atomic; blocks keep the blank lines after them; joined they are the text."""
    lines = text.splitlines(keepends=True)
    out: list[tuple[str, bool]] = []
    i = 0
    kind = lambda s: "blank" if not s.strip() else "fence" if re.match(r" {0,3}(```+|~~~+)", s) else "table" if re.match(r"\s*\|.*\|\s*$", s) else "text"
    while i < len(lines):
        j, this = i + 1, kind(lines[i])
        if i == 0 and lines[0].strip() == "---" and any(x.strip() in ("---", "...") for x in lines[1:]):
            this, j = "front", 2 + next(k for k, x in enumerate(lines[1:]) if x.strip() in ("---", "..."))
        elif this == "fence":
            mark = re.match(r" {0,3}(```+|~~~+)", lines[i])[1]
            close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$")
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            j = min(j + 1, len(lines))
        else:
            while j < len(lines) and kind(lines[j]) == this:
                j += 1
        while j < len(lines) and not lines[j].strip():
            j += 1
        out.append(("".join(lines[i:j]), this in ("front", "fence", "table")))
        i = j
    return out


def markdown(text: str, size: int = 2000) -> list[str]:
    """Pack blocks into ``size`` characters; atomic blocks stay whole, long paragraphs split at lines; joined chunks are the text."""
    if size <= 0:
        raise ValueError("size must be positive")
    units = [u for block, atomic in markdown_blocks(text) for u in ([block] if atomic or len(block) <= size else block.splitlines(keepends=True))]
    out, current = [], ""
    for unit in units:
        if current and len(current) + len(unit) > size:
            out.append(current)
            current = ""
        current += unit
    return [*out, current] if current else out


def by_length(text: str, size: int = 2000, overlap: int = 200) -> list[str]:
    """Windows of characters at a fixed stride, four characters a token."""
    return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), size - overlap)] if text else []


def by_separator(text: str, separator: str, size: int) -> list[str]:
    """Parts that keep their separator, packed greedily."""
    out, current = [], ""
    for part in re.findall(rf"(?s).*?{re.escape(separator)}|.+$", text):
        if current and len(current) + len(part) > size:
            out.append(current)
            current = ""
        current += part
    return [*out, current] if current else out


def semantic_merge(groups: list[str], least: int = MIN_SIZE, most: int = MAX_SIZE) -> list[str]:
    """A short group takes in the next one, once, if both fit; groups that are too long are split at sentences."""
    out: list[str] = []
    rest = iter(groups)
    held = next(rest, None)
    while held is not None:
        after = next(rest, None)
        if after is not None and len(held) < least and len(held) + 1 + len(after) <= most:
            held, after = f"{held} {after}", next(rest, None)
        out.append(held)
        held = after
    return [p for g in out for p in ([g] if len(g) <= most else recursive(g, ChunkConfig(most, 0)))]


def semantic(text: str, embed: Callable[[str], list[float]], threshold: float = SEMANTIC_THRESHOLD, buffer: int = 1) -> list[str]:
    """Sentences are grouped until a window of them is less similar than ``threshold`` to the next; ``embed`` is the caller's."""
    import numpy as np

    parts = sentences(text)
    if len(parts) < 2:
        return [text.strip()] if text.strip() else []
    windows = [" ".join(parts[max(0, i - buffer + 1) : i + buffer]) for i in range(len(parts))]
    x = np.array([embed(w) for w in windows], float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cuts = [0, *(np.flatnonzero((x[1:] * x[:-1]).sum(1) < threshold) + 1).tolist(), len(parts)]
    return semantic_merge([" ".join(parts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """Deterministic bag of words, for tests and offline use."""
    import zlib

    out = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()):
        out[zlib.crc32(w.encode()) % dim] += 1.0
    return out


STRATEGIES: dict[str, Callable[[str], list[str]]] = {
    "fixed": lambda t: fixed(t, ChunkConfig()),
    "recursive": lambda t: recursive(t, ChunkConfig()),
    "markdown": markdown,
    "length": by_length,
    "semantic": lambda t: semantic(t, hashed_embedding),
}


def chunk(docs: DataFrame, keep: list[str], text: str = "text", strategy: str | Callable[[str], list[str]] = "recursive") -> DataFrame:
    """``keep`` columns with (chunk_index, content) of each text; null texts give none."""
    fn = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    return flat_map_text(docs, text, lambda t: enumerate(fn(t)) if t else (), "chunk_index int, content string", keep)


def hierarchical(docs: DataFrame, keep: list[str], text: str = "text", parent_size: int = PARENT_SIZE, child_size: int = CHILD_SIZE, child_overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Parents (not searchable) and their children (role, family, parent_index, child_index, content, searchable)."""
    parent, child = ChunkConfig(parent_size, 0), ChunkConfig(child_size, child_overlap)

    def families(t: str | None):
        for p, content in enumerate(recursive(t, parent) if t else ()):
            yield "parent", p, None, content, False
            for c, piece in enumerate(recursive(content, child)):
                yield "child", p, c, piece, True

    out = flat_map_text(docs, text, families, "role string, parent_index int, child_index int, content string, searchable boolean", keep)
    family = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in keep], F.col("parent_index").cast("string")), 256)
    return out.withColumn("family", family)
