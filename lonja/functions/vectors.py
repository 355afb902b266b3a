"""Vectors as arrays, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: str | Column) -> Column:
    """Length 1; the zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def quantised(v: str | Column) -> Column:
    """Whole numbers from -127 to 127, half to even."""
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") * 127))).cast("tinyint"))


def restored(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(v, lambda x: x / F.lit(127.0))


def distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def cosine_of_distance(d: str | Column) -> Column:
    """The cosine of two vectors of length 1 at a distance."""
    d = F.col(d) if isinstance(d, str) else d
    return 1 - d * d / 2
