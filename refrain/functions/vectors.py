"""Vector arithmetic as column expressions: 32-bit inputs, 64-bit sums in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double") * x))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def normalised(v: Column) -> Column:
    """Unit vector; null where there is no direction."""
    n = squared_norm(v)
    scale = (F.lit(1.0) / F.sqrt(n)).cast("float")
    return F.when(n > 1e-20, F.transform(v, lambda x: (x * scale).cast("float")))


def quantised(unit: Column) -> Column:
    """Components in -127..127, halves away from zero."""
    clamped = lambda x: F.least(F.greatest(x, F.lit(-1.0).cast("float")), F.lit(1.0).cast("float"))
    return F.transform(unit, lambda x: F.round((clamped(x) * F.lit(127.0).cast("float")).cast("float")).cast("tinyint"))


def quantised_norm(q: Column) -> Column:
    return F.sqrt(_sum(F.transform(q, lambda x: x.cast("double") * x))).cast("float")


def asymmetric_score(unit: Column, q: Column, q_norm: Column) -> Column:
    """Cosine of a unit vector with a quantised one; each product is a 32-bit number."""
    products = F.zip_with(unit, q, lambda x, y: (x * y).cast("float").cast("double"))
    return (_sum(products) / q_norm.cast("double")).cast("float")


def cosine(a: Column, b: Column) -> Column:
    """-1 for vectors without direction or of different lengths."""
    aa, bb = squared_norm(a), squared_norm(b)
    bad = (F.size(a) != F.size(b)) | (F.size(a) == 0) | (aa <= 1e-18) | (bb <= 1e-18)
    return F.when(bad, F.lit(-1.0)).otherwise(dot(a, b) / F.sqrt(aa * bb)).cast("float")
