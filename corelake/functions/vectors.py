"""Vectors of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): the vectors of a list column as doubles, and the places in the batch that they stand at.

    Null vectors and those of another length than width (by default that of the batch's first vector) have no row;
    a null component is NaN.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if width is None:
        known = lengths[lengths >= 0]
        width = int(known[0]) if len(known) else 0
    places = np.flatnonzero(lengths == width)
    if len(places) < len(lengths):
        column = column.take(pa.array(places))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(places), width), places


def all_rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a list column; raises if one is null or of another length."""
    rows, places = matrix(column, width)
    if len(places) < len(column):
        raise ValueError(f"{len(column) - len(places)} vectors are null or differ in length: validate the points first")
    return rows


def stacked(vectors: list) -> np.ndarray:
    """Collected vectors as a matrix; raises if one is null or of another length."""
    if any(v is None for v in vectors) or len(set(map(len, vectors))) > 1:
        raise ValueError("vectors are null or differ in length: validate the points first")
    return np.array(vectors, np.float64)


def lists(rows: np.ndarray, holes: bool = False) -> pa.Array:
    """A list column of the rows; with holes a NaN is a null component."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32) if rows.size else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel(), from_pandas=holes))
