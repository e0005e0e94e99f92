"""Vector expressions on arrays, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or null, has no length, or the dimensions differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(fits, dot(a, b) / norm).otherwise(F.lit(0.0))


def require_dimension(v: Column, n: int) -> Column:
    """The vector itself, or an error naming the fault; meant for inputs that promise a dimension."""
    return F.when(F.size(v) == n, v).otherwise(F.raise_error(F.lit(f"vector is null or not of dimension {n}")))


def sigmoid(x: Column) -> Column:
    """Stable on both sides; null and non-finite stay null."""
    e = F.exp(-F.abs(x))
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(fine, F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e)))
