"""Column expressions on array<float|double> vectors, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first component on."""
    return F.aggregate(F.zip_with(as_double(F.col(a) if isinstance(a, str) else a), as_double(F.col(b) if isinstance(b, str) else b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, floor: float = 1e-12) -> Column:
    """v / |v|; a norm below floor counts as floor, so the zero vector stays zero."""
    # the norm is a lambda's variable, so it is computed once a vector and not once a component
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(floor))), lambda n: F.transform(as_double(v), lambda x: x / n)), 1)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))
