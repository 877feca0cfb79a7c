"""Zero-copy moves between Arrow list columns and numpy matrices.

Spark hands ``ARRAY<DOUBLE>`` columns to ``mapInArrow`` / ``applyInArrow``
as Arrow ``list<double>`` arrays.  A block of equal-length rows is one
flat buffer, so it can be viewed as an m x n matrix without a Python
loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_to_matrix(arr, width: int | None = None) -> np.ndarray:
    """Arrow list<double> array (or chunked array) -> m x n float64 matrix."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    m = len(arr)
    if m == 0:
        return np.zeros((0, width or 0))
    if arr.null_count:
        raise ValueError("matrix rows must not be NULL")
    values = arr.flatten()
    if values.null_count:
        raise ValueError("matrix entries must not be NULL")
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lengths = np.diff(arr.offsets.to_numpy())
    n = int(lengths[0])
    if not np.all(lengths == n):
        raise ValueError("all matrix rows must have the same length")
    if width is not None and n != width:
        raise ValueError(f"all matrix rows must have the same length (expected {width}, got {n})")
    return flat.reshape(m, n)


def ragged_to_matrices(arr, heights, widths) -> list[np.ndarray]:
    """Arrow list<double> of row-major blocks with given shapes -> list of matrices."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    offsets = arr.offsets.to_numpy()
    offsets = offsets - offsets[0]  # flatten() starts at the first offset of a sliced array
    out = []
    for i, (h, w) in enumerate(zip(heights, widths)):
        out.append(flat[offsets[i] : offsets[i + 1]].reshape(int(h), int(w)))
    return out


def matrix_to_list(mat: np.ndarray) -> pa.ListArray:
    """m x n matrix -> Arrow list<double> with one row per matrix row."""
    mat = np.ascontiguousarray(mat, dtype=np.float64)
    m = mat.shape[0]
    n = mat.shape[1] if mat.ndim == 2 else 0
    offsets = np.arange(m + 1, dtype=np.int32) * n
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(mat.reshape(-1)))


def matrices_to_list(mats: list[np.ndarray]) -> pa.ListArray:
    """List of matrices -> Arrow list<double>, one flattened (row-major) matrix per row."""
    sizes = np.array([x.size for x in mats], dtype=np.int64)
    offsets = np.zeros(len(mats) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    values = (
        np.concatenate([np.ascontiguousarray(x, dtype=np.float64).reshape(-1) for x in mats])
        if mats
        else np.zeros(0)
    )
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
