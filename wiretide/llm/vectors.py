"""Embedding columns: which rows count, and distinct vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True unless the vector is null, empty, zero, or holds null, NaN or infinite components."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return F.coalesce(F.exists(vector, lambda x: x != 0) & ~F.exists(vector, bad), F.lit(False))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) floats of a list array whose rows all have dim components."""
    return np.asarray(col.flatten()).reshape(-1, dim)
