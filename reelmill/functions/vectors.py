"""Array arithmetic on Arrow batches: every function sees whole batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def matrix_of(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column without nulls as a float64 matrix; rows of unequal length are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, dim or 0))
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1 or (dim is not None and lengths[0] != dim):
        raise ValueError(f"Vectors have lengths {lengths.tolist()[:5]}, expected {dim or 'one length'}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their norm; zero rows stay zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


def _pairwise(left: pa.Array, right: pa.Array, reduce) -> pa.Array:
    """``reduce(L, R)`` on the rows where both vectors exist and have equal length, null elsewhere."""
    left_len = np.asarray(left.value_lengths().fill_null(-1))
    right_len = np.asarray(right.value_lengths().fill_null(-2))
    out = np.full(len(left), np.nan)
    for length in np.unique(left_len[left_len == right_len]):
        rows = np.flatnonzero((left_len == length) & (right_len == length))
        index = pa.array(rows)
        a, b = matrix_of(left.take(index)), matrix_of(right.take(index))
        out[rows] = reduce(a, b) if length else 0.0
    return pa.array(out, mask=np.isnan(out))


@arrow_udf(T.DoubleType())
def _dot(left: pa.Array, right: pa.Array) -> pa.Array:
    return _pairwise(left, right, lambda a, b: np.einsum("ij,ij->i", a, b))


@arrow_udf(T.DoubleType())
def _cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    return _pairwise(left, right, lambda a, b: np.einsum("ij,ij->i", unit_rows(a), unit_rows(b)))


@arrow_udf(T.DoubleType())
def _mean_squared_error(left: pa.Array, right: pa.Array) -> pa.Array:
    return _pairwise(left, right, lambda a, b: np.mean((a - b) ** 2, axis=1))


@arrow_udf(T.ArrayType(T.DoubleType()))
def _unit(vectors: pa.Array) -> pa.Array:
    # ragged input keeps its own offsets, so each row is scaled by its own norm
    lengths = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    norms = np.sqrt(np.bincount(owner, weights=flat * flat, minlength=len(lengths)))
    scaled = flat / np.where(norms == 0, 1.0, norms)[owner]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = pa.array(np.asarray(vectors.is_null()))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled), mask=mask)


def dot(left: Column, right: Column) -> Column:
    """Dot product; 0 for vectors of unequal length, null where one is missing."""
    raw = _dot(left, right)
    return F.when(F.size(left) != F.size(right), F.lit(0.0)).otherwise(raw)


def cosine(left: Column, right: Column) -> Column:
    return _cosine(left, right)


def mean_squared_error(left: Column, right: Column) -> Column:
    return _mean_squared_error(left, right)


def l2_normalize(vector: Column) -> Column:
    return _unit(vector)
