"""Vector expressions over arrays of floats, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is null or has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def round_codec(v: Column) -> Column:
    """The vector as stored: six decimals."""
    return F.transform(v, lambda x: F.round(x.cast("double"), 6))


def encode(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def decode(text: Column) -> Column:
    return F.transform(F.split(F.translate(text, "[] ", ""), ","), lambda x: x.cast("double"))
