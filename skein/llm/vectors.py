"""Tables of vectors: which rows take part, and their common length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """True where a vector is there and all its entries are finite numbers."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda c: F.coalesce(entry(c.cast("double")), F.lit(False))), F.lit(False))


def common_length(df: DataFrame, vec_col: str) -> int:
    """The most frequent length of the vectors (ties: the longer), 0 for no vector; one number per length is collected."""
    found = df.groupBy(F.size(vec_col).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column whose lists have ``width`` entries and no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)
