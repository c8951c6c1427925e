"""Vector expressions over arrays of numbers, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import col


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 for null, empty, unequal or zero vectors."""
    a, b = col(a), col(b)
    n = norm(a) * norm(b)
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fine & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def parse_embedding(text: str | Column) -> Column:
    """``[1,2]`` text to an array of doubles; null if malformed, empty or not finite."""
    v = F.from_json(col(text), "array<double>", {"mode": "PERMISSIVE"})
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), v)


def unit(a: str | Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n))
