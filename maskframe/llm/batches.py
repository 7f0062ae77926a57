"""Running a function over texts in slices of bounded size, as Arrow buffers.

A worker sees a slice of at most ``SLICE_BYTES`` bytes of text (or one longer
text), whatever the session's batch size is; texts are never cut.  Numpy needs
some fifty times a slice for a moment; operators that gain from meeting a word
more often ask for larger slices.

Workers serve one stage after the other, and more of them wait than work.  What
numpy has freed would stay with each for all that time, so that a worker gives
it back at the end of a task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 19
LARGE_SLICE_BYTES = 1 << 21


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and where each text starts and ends.  Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    size = int(at[-1] - at[0])
    if not size:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, size, int(at[0])), at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``most`` bytes together."""
    _, at = text_buffer(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def give_back() -> None:
    """Returns memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it, and only glibc needs it
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, after which a worker holds no more memory than before."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str,
              most: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``schema`` made slice by slice; ``make`` runs once in each task and returns the function that does it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, text, most):
                work = work or make()
                yield pa.RecordBatch.from_pydict(work(part))

    return map_batches(df, run, schema)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns can't clash."""
    return df.select(*(F.col(f"`{name}`").alias(alias) for alias, name in columns.items()))


def ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of which row i has the next ``sizes[i]`` values."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
