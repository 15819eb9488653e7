"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    n = norm2(a) * norm2(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def mean_of(vectors: Column) -> Column:
    """Mean of an array of equally long vectors; null for none."""
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def word_vector(states: Column) -> Column:
    """Mean of sub-token states without the first and the last."""
    return mean_of(F.slice(states, F.lit(2), F.greatest(F.size(states) - 2, F.lit(0))))
