"""Arrays of numbers in Arrow batches as numpy matrices, and which of them are whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: str) -> Column:
    """Whether a vector is there and every entry of it is a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def whole_rows(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a whole vector, which becomes an array of double."""
    return df.withColumn(vector, F.col(vector).cast("array<double>")).where(whole(vector))


def one_length(df: DataFrame, vector: str) -> int:
    """The length that all vectors share (0 without rows); different lengths are an error."""
    got = df.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if got["a"] != got["b"]:
        raise ValueError(f"vectors of {got['a']} to {got['b']} entries")
    return got["a"] or 0


def matrix(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """Rows of one length as a matrix; neither lists nor entries are null."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype).reshape(len(column), width)


def floors(values: np.ndarray, factor: float, limit: float) -> np.ndarray:
    """floor(factor * x) as long; a value of ``limit`` or more in size is an error, since what is computed from it would not be exact."""
    out = np.floor(values * factor)
    if out.size and np.abs(out).max() >= limit:
        raise OverflowError(f"a vector's entry times {factor:g} is {limit:g} or more in size")
    return out.astype(np.int64)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def is_null(column: pa.Array) -> np.ndarray:
    return pc.is_null(column).to_numpy(zero_copy_only=False)
