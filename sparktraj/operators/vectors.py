"""Arithmetic on array<double> columns."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def avg_vector(df: DataFrame, keys: list[str], dim: int, x: str = "x", out: str = "x", weight: str | None = None) -> DataFrame:
    """Mean vector per group (or weighted sum): one aggregate per dimension, combined before the shuffle."""
    f = (lambda i: F.avg(F.col(x)[i])) if weight is None else (lambda i: F.sum(F.col(x)[i] * F.col(weight)))
    return df.groupBy(*keys).agg(F.array(*[f(i) for i in range(dim)]).alias(out))


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def distance(a: str, b: str) -> Column:
    return F.sqrt(squared_distance(a, b))


def explode_dims(df: DataFrame, *keep: str, x: str = "x") -> DataFrame:
    """(keep..., dim, value): one row per element."""
    return df.select(*keep, F.posexplode(x).alias("dim", "value"))


def matrix(col, dim: int | None = None) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(n, dim or (len(flat) // n if n else 1))
