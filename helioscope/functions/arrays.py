"""Vector arithmetic on array columns by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x * s)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column, p: float = 2) -> Column:
    """p-norm; p may be infinity."""
    if p == float("inf"):
        return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    if p == 2:
        return F.sqrt(dot(a, a))
    return F.pow(total(F.transform(a, lambda x: F.pow(F.abs(x.cast("double")), F.lit(p)))), F.lit(1 / p))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def cumsum(a: Column) -> Column:
    zero = F.slice(F.array(F.lit(0.0)), 1, 0)
    return F.aggregate(a, zero, lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x)))


def diff(a: Column) -> Column:
    return F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y), F.lit(p)))), F.lit(1 / p))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def canberra(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x.cast("double") - y), F.abs(x.cast("double")) + F.abs(y.cast("double"))), F.lit(0.0))))


def braycurtis(a: Column, b: Column) -> Column:
    return F.try_divide(manhattan(a, b), total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") + y))))


def hamming(a: Column, b: Column) -> Column:
    """Share of places that differ."""
    return total(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0.0).otherwise(1.0))) / F.size(a)


DISTANCES = {"euclidean": euclidean, "sqeuclidean": squared_euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "canberra": canberra, "braycurtis": braycurtis, "hamming": hamming}


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def polyval(coefs: list[float], x: Column) -> Column:
    """Horner's rule; the highest power first."""
    out = F.lit(0.0)
    for c in coefs:
        out = out * x + c
    return out
