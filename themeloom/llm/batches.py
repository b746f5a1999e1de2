"""Arrow batches in bounded pieces, for the operators that work in numpy."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096

SPACES = b" \t\n\r\x0b\x0c"  # what bytes.split() splits on: \x20 and \x09-\x0D


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows, CHUNK_ROWS at most, whose `column` holds about `limit` bytes together; a longer row stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    row = 0
    while row < batch.num_rows:
        base = ends[row - 1] if row else 0
        stop = max(row + 1, min(row + CHUNK_ROWS, int(np.searchsorted(ends, base + limit, side="right"))))
        yield batch.slice(row, stop - row)
        row = stop


def release() -> None:
    """Hand freed memory back to the system, from Arrow's pool and, where the C library can, from its own."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def map_texts(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], list], column: str = "text", limit: int = CHUNK_BYTES,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """`work` turns a piece of a batch into the columns of `schema`, one entry for each row; `done` is called at the end of a task.

    Python workers outlive their tasks, so what a task cached or freed has to be let go, or it is held beside what later stages need.
    """

    def run(batches):
        try:
            for batch in batches:
                for piece in slices(batch, column, limit):
                    yield work(piece)
        finally:
            if done is not None:
                done()
            release()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()
