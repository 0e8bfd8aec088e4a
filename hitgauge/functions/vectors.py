"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns. All arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(_double(v), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either of them has no length."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms).when(norms == 0, F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def distance_to_similarity(distance: Column) -> Column:
    return 1 - distance


def normalize(v: Column) -> Column:
    """Unit-length copy as ARRAY<FLOAT>; a zero vector stays zero."""
    norm = l2_norm(v)
    return F.transform(
        _double(v), lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))
    ).cast("array<float>")


def dims(v: Column) -> Column:
    return F.size(v)
