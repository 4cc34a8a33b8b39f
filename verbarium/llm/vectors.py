"""Integer vectors of an `embeddings` table, as the vector operators read them.

Defined cases: rows whose vector is null, or holds null or non-finite components, take no part; integers are held to +-2^24, so that scores and squared
distances fit a long; a vector shorter than the longest is continued by zeros; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 24


def integer_vectors(embeddings: DataFrame, scale: int, label: Column | None = None) -> DataFrame:
    """vec_id, label, x (floor(scale * component) of each component, computed in doubles)."""
    v, top = F.col("embedding").cast("array<double>"), float(LIMIT)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(top)), F.lit(-top))).cast("int"))
    return embeddings.where(v.isNotNull() & whole).select("vec_id", (F.col("label") if label is None else label).alias("label"), ints.alias("x"))


def dense(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, short lists continued by zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int32)
    out = np.zeros((len(sizes), width), dtype=np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def binaries(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column, little-endian."""
    rows = np.ascontiguousarray(matrix)
    each = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * each), pa.py_buffer(rows)])


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """binaries() read back."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1) if rows else np.zeros((0, 1), dtype=kind)
