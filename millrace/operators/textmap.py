"""Apply a Python function of one text to a column, in Arrow batches: one output row for each tuple it yields."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: Rows and bytes of text that are mapped at once: what a function makes of them is held until it is passed on.
ROWS, BYTES = 512, 1 << 20


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ROWS rows and, but for a last row, BYTES bytes of text (its ``column``)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = size[low - 1] if low else 0
        high = min(low + ROWS, int(np.searchsorted(size, before + BYTES)) + 1, batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def flat_map_text(df: DataFrame, text: str, fn: Callable[..., Iterable[tuple]], fields: str, keep: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and one row for each tuple of ``fn(text, *extra columns)``; ``fields`` is their schema."""
    source = df.select(*keep, *[F.col(c).alias(f"__x{i}") for i, c in enumerate((text, *extra))])
    added: StructType = _parse_datatype_string(fields)
    kept = StructType([f for f in source.schema if not f.name.startswith("__x")])
    types = [f.type for f in to_arrow_schema(added)]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, n)):
            rows: list[int] = []
            out: list[tuple] = []
            for i, args in enumerate(zip(*[batch.column(n + k).to_pylist() for k in range(1 + len(extra))], strict=True)):
                for made in fn(*args):
                    rows.append(i)
                    out.append(made)
            index = pa.array(rows, pa.int64())
            columns = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in range(n)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*kept.names, *added.names])

    return source.mapInArrow(run, StructType([*kept, *added]))
