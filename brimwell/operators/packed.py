"""Packed pixels as numpy arrays: what tasks of image operators share.

A batch's arrays are one buffer with offsets; null pixels are NaN there.  No Python object is made for a pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All pixels of a list column as doubles, and where each row's begin; a null row has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten()
    size = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0), np.append(0, np.cumsum(size))


def rows(batch: pa.RecordBatch | pa.Table, column: str) -> Iterator[np.ndarray]:
    """The pixels of each row."""
    values, at = flat(batch.column(column))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield values[a:b]


def volume(table: pa.Table, column: str, width: int) -> np.ndarray:
    """(rows, height, width); all rows must be whole images of one size."""
    values, at = flat(table.column(column))
    size = np.diff(at)
    if (size != size[0]).any() or size[0] % width:
        raise ValueError(f"images of one stack must have one size, whole rows of {width} pixels")
    return values.reshape(len(size), -1, width)


def lists(values: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """(rows, pixels) as a list for each row; NaN becomes null."""
    n, size = values.shape
    own = pa.array(values.ravel(), mask=np.isnan(values.ravel())) if values.dtype.kind == "f" else pa.array(values.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), own.cast(kind) if kind else own)
