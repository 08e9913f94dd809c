"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 16 * 1024 * 1024
"""Text that a task looks at in one piece; a longer single text is a piece of its own."""


def released() -> None:
    """Give freed memory back, which a worker would else keep while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def texts(column: pa.Array) -> pa.Array:
    """A string array in which null is the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in pieces of up to ``limit`` bytes of ``column``; behind the last, freed memory is given back."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])
        del batch  # not held while the next one is read
    released()
