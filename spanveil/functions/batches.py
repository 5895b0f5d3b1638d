"""Arrow batches in slices of bounded size.

Spark hands over many rows at a time (10,000 or 64 MB). What Python makes of
them, strings and tuples above all, takes many times as much, so functions make
it for a slice at a time. Batches that come back may be cut anywhere; only the
order of the rows counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
# What an element counts beside its text.
ELEMENT_BYTES = 8


def list_starts(lists: pa.ListArray) -> np.ndarray:
    """Where each row's elements begin in the flat array, and the end of all; null rows have none."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def row_bytes(values: pa.Array) -> np.ndarray:
    """About how much each row holds."""
    kind = values.type
    if pa.types.is_struct(kind):
        return sum(map(row_bytes, values.flatten()), np.zeros(len(values), np.int64))
    out = np.full(len(values), ELEMENT_BYTES, dtype=np.int64)
    if pa.types.is_list(kind):
        sums = np.concatenate([[0], np.cumsum(row_bytes(values.flatten()))])
        out += np.diff(sums[list_starts(values)])
    elif pa.types.is_string(kind) or pa.types.is_binary(kind):
        out += pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    return out


def slices(batches: Iterable, limit: int = SLICE_BYTES) -> Iterator:
    """The rows of all batches (record batches, arrays or tuples of arrays) in slices of about ``limit`` bytes, of a row at least."""
    for batch in batches:
        several = isinstance(batch, tuple)
        columns = batch if several else batch.columns if isinstance(batch, pa.RecordBatch) else (batch,)
        ends = np.cumsum(sum(map(row_bytes, columns), np.zeros(len(columns[0]), np.int64)))
        low = 0
        while low < len(ends):
            room = (ends[low - 1] if low else 0) + limit
            high = max(low + 1, int(np.searchsorted(ends, room, "right")))
            yield tuple(c.slice(low, high - low) for c in batch) if several else batch.slice(low, high - low)
            low = high
        # Workers are reused, and the next batch comes while this one is held: hand back what is not needed.
        del batch, columns
        pa.default_memory_pool().release_unused()
