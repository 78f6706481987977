"""Arrow helpers shared by the operators that run numpy inside tasks."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Characters of text handled at once inside a task; a longer text is handled alone.
PIECE_CHARS = 1_000_000

#: Bytes of an Arrow batch where rows are long (texts, whole sets); the JVM and the worker hold a few of them at once.
BATCH_BYTES = 8 << 20

#: Seconds after which a running task gives free memory back once more.
TRIM_SECONDS = 2.0


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows of a batch, as (first row, texts), that hold about ``limit`` characters each, so memory stays bounded."""
    values = batch.column(batch.schema.get_field_index(column))
    first, texts, chars = 0, [], 0
    for i in range(len(values)):
        text = values[i].as_py()
        n = len(text) if text is not None else 0
        if texts and chars + n > limit:
            yield first, texts
            first, texts, chars = i, [], 0
        texts.append(text)
        chars += n
    if texts:
        yield first, texts


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker outlives the task: what is free is given back now and then, and at the end."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for batch in run(batches):
            yield batch
            if time.monotonic() - last > TRIM_SECONDS:
                release()
                last = time.monotonic()
        batch = None  # else the last one would be held
        release()

    return through
