"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity, 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def valid(vec: str, dim: int) -> Column:
    """Of the right length, without nulls or NaN, not all zero."""
    v = F.col(vec)
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def parse(text) -> Column:
    """``"[0.1, 2]"`` to an array of doubles; null where it is none."""
    return F.from_json(text, "array<double>")


def unit(vec) -> Column:
    n = norm(vec) + F.lit(1e-9)
    return F.transform(vec, lambda x: x.cast("double") / n)
