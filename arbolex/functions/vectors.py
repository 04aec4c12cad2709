"""Column functions on vectors (array<float>). Arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def part(v: Column, first: int, size: int) -> Column:
    """Dimensions first .. first + size."""
    return F.slice(v, first + 1, size) if size else F.array().cast("array<float>")


def scaled(v: Column, first: int, size: int, ratio: float) -> Column:
    """The vector with dimensions first .. first + size times ratio."""
    return F.transform(v, lambda x, i: F.when((i >= first) & (i < first + size), x * F.lit(ratio)).otherwise(x.cast("double")).cast("float"))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero or a vector is missing."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def weighted(v: Column, sizes: tuple[int, int, int], a_ratio: float) -> Column:
    """Doubles, the associative dimensions times a_ratio: the cosine of all dimensions is that of these vectors."""
    dep, assoc, _ = sizes
    return F.transform(v, lambda x, i: x.cast("double") * F.when((i >= dep) & (i < dep + assoc), F.lit(a_ratio)).otherwise(F.lit(1.0)))


def float_class(x: Column) -> Column:
    """nan, infinite, zero, subnormal or normal, as 32-bit floats count."""
    return (
        F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "infinite").when(x == 0, "zero")
        .when(F.abs(x.cast("double")) < F.lit(1.1754943508222875e-38), "subnormal").otherwise("normal")
    )
