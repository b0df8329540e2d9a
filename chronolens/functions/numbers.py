"""Numeric functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length one; the zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is the zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """(lo, hi) of the Wilson interval; (0, 0) without cases."""
    p, m = hits / n, n.cast("double")
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    zero = F.lit(0.0)
    return F.struct(F.when(n > 0, F.greatest(centre - half, zero)).otherwise(zero).alias("lo"), F.when(n > 0, F.least(centre + half, F.lit(1.0))).otherwise(zero).alias("hi"))


def lower_percentile(values: Column, q: float) -> Column:
    """``sorted[min(n - 1, int(q (n - 1)))]`` of a collected array: an element, never between two."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.element_at(s, F.least(n, F.floor(F.lit(q) * (n - 1)).cast("int") + 1))
