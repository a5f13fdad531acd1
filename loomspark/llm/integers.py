"""Vectors as exact integers, shared by the operators that compute with them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether the vector isn't null and holds neither null nor NaN nor infinite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component x, taken as a double, as array<bigint>. Vectors whose integers leave no room for exact 64-bit
    sums of products (size * max^2 of 2**60 or more) raise an error, as no right result could be given for them."""
    rounded = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    most = F.aggregate(vector, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(F.lit(float(scale)) * x.cast("double"))))
    fits = (most + 1) * (most + 1) * F.size(vector) < float(1 << 60)
    return F.when(fits, rounded).otherwise(F.raise_error(F.lit("components are too large for exact 64-bit sums of products")).cast("array<bigint>"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, all of ``width`` components, as int64."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)
