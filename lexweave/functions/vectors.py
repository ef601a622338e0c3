"""Vector columns: arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """a by its norm, which is computed once a vector; null items for a zero vector."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.try_divide(x, n))), 1)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(y: Column, p: Column) -> Column:
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def inversions(s: Column) -> Column:
    """Pairs i < j with s[i] < s[j]: 0 for a descending order."""
    n = F.size(s)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when((i < j) & (F.get(s, i) < F.get(s, j)), 1).otherwise(0))))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x)
