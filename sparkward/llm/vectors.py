"""Arrow list columns as matrices, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of list in the column; null lists are left out, null entries are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return
    kept = column.take(pa.array(rows))
    sizes = pc.list_value_length(kept).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield rows[at], flat[(ends[at] - d)[:, None] + np.arange(d)]


def stacked(values: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for binary values that hold doubles."""
    sizes = np.array([-1 if v is None else len(v) for v in values], np.int64)
    for size in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(values[i] for i in at), np.float64).reshape(len(at), size // 8)
