"""Arrow list columns as numpy matrices, inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Matrix cells worked on at a time where a batch of vectors is taken in parts.
CELLS_AT_ONCE = 1 << 19


def to_matrix(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a float64 matrix, and a mask of the non-NULL rows.

    NULL vectors become zero rows. A vector of another length is an error, as
    it is in a store with fixed dimensions.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    present = ~np.asarray(vectors.is_null())
    kept = vectors.drop_null() if vectors.null_count else vectors
    lengths = kept.value_lengths().to_numpy(zero_copy_only=False)
    if dims is None:
        dims = int(lengths[0]) if len(lengths) else 0
    if (lengths != dims).any():
        bad = int(lengths[lengths != dims][0])
        raise ValueError(f"a vector has {bad} components, not {dims}")
    values = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = np.zeros((len(vectors), dims))
    matrix[present] = values.reshape(-1, dims) if dims else 0.0
    return matrix, present


def from_matrix(
    matrix: np.ndarray, present: np.ndarray | None = None, dtype: type = np.float32
) -> pa.Array:
    """Matrix rows as a list column; rows outside ``present`` are NULL."""
    rows, dims = matrix.shape
    offsets = np.arange(0, (rows + 1) * dims, dims, dtype=np.int32) if dims else np.zeros(
        rows + 1, dtype=np.int32
    )
    values = pa.array(np.ascontiguousarray(matrix, dtype=dtype).ravel())
    mask = None if present is None or present.all() else pa.array(~present)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def row_ranges(sizes: np.ndarray, most: int, rows: int | None = None) -> Iterator[slice]:
    """Consecutive rows whose ``sizes`` sum up to ``most``, and ``rows`` at most; one row at least.

    An Arrow batch is bounded in rows only. What is worked out beside it is bounded by this.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        stop = stop if rows is None else min(stop, start + max(rows, 1))
        yield slice(start, stop)
        start = stop


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]
