"""Arrow list columns to numpy matrices and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are present, as a matrix, and the mask saying which those are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    present = np.asarray(column.is_valid())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    n = int(present.sum())
    return values.reshape(n, -1 if n else 0), present


def list_array(rows: np.ndarray, present: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per entry of ``present``, null where it is false."""
    lengths = np.where(present, rows.shape[1] if rows.ndim == 2 else 0, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind), mask=pa.array(~present))


def shares(batch: pa.RecordBatch, lists: pa.ListArray, entries: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``entries`` list entries, or one row if its list is longer."""
    ends, at = lists.offsets.to_numpy(), 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, int(ends[at]) + entries, "right")) - 1
        to = max(min(most, at + rows), at + 1)
        yield batch.slice(at, to - at)
        at = to
