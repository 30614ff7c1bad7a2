"""Rows of an array column as whole-number matrices, for the operators on embeddings.

A vector that is null, empty, or holds a null or a component that isn't finite goes. Vectors of
different lengths in one table are an error, as are components too large for exact sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scaled components stay below this, so that sums over 2^22 rows of one task stay exact in 64 bits.
LARGEST = 1 << 40
#: Components that a task holds as numbers at a time.
CELLS = 1 << 21


def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector to keep, and these vectors as doubles."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64())
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    whole = np.bincount(row, weights=~np.isfinite(values), minlength=len(size)) == 0
    keep = np.flatnonzero(whole & (size > 0))
    if not len(keep):
        return keep, np.zeros((0, 0))
    if size[keep].min() != size[keep].max():
        raise ValueError("vectors differ in length")
    return keep, values[np.isin(row, keep)].reshape(len(keep), -1)


def whole(values: np.ndarray, scale: int, shift: int = 0) -> np.ndarray:
    """floor(scale * value) + shift as 64-bit numbers."""
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST / scale:g} and more have no exact sums")
    return scaled.astype(np.int64) + shift


def slices(batch: pa.RecordBatch, column: str, cells: int = CELLS):
    """The batch in parts of about ``cells`` components of ``column``."""
    held = pc.sum(pc.list_value_length(batch.column(column))).as_py() or 0
    step = max(1, batch.num_rows * cells // max(held, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
