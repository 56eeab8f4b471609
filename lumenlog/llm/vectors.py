"""What the two vector operators share: clean float64 rows out of Arrow list columns, and the rows that count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(name: str) -> Column:
    """Neither null, empty, zero, nor with a null or non-finite component (native; false for a null array)."""
    v = F.col(name).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def by_length(column: pa.Array) -> list[np.ndarray]:
    """Row numbers of a list column, by the length of their lists, so that each set makes a matrix."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]
