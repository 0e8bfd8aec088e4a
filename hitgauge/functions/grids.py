"""Evenly spaced points, computed in the order that gives the same doubles as ``linspace``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_step(lo: Column, hi: Column, steps: Column) -> Column:
    """Distance between neighbours; NULL where the grid has one point or does not ascend."""
    return F.when((steps > 1) & (lo < hi), (hi - lo) / (steps - 1))


def grid_point(lo: Column, hi: Column, steps: Column, i: Column) -> Column:
    """Point ``i`` of ``steps`` points from ``lo`` to ``hi``; the last one is exactly ``hi``."""
    return (
        F.when(steps <= 1, lo)
        .when(i == steps - 1, hi)
        .otherwise(i * ((hi - lo) / (steps - 1)) + lo)
    )


def grid_indices(steps: Column) -> Column:
    """Array 0 .. steps-1, for ``explode``."""
    return F.sequence(F.lit(0).cast("long"), (steps - 1).cast("long"))


def with_points_reached(
    df: DataFrame, out: str, value: str, lo: str, step: str, hi: Column, steps: Column
) -> DataFrame:
    """Add ``out``: how many points of the row's grid are <= ``value``; 0 for NULL and NaN.

    ``step`` is the column of :func:`grid_step`. The quotient finds the point up to one rounding
    error, so its two neighbours are compared with the exact points. ``value`` must not be below
    ``lo`` where the grid does not ascend: all its points are then reached.
    """
    v, low, width, guess = F.col(value), F.col(lo), F.col(step), F.col("_guess")

    def above(i: Column) -> Column:
        return F.when(i == steps - 1, hi).otherwise(i * width + low) > v

    with_guess = df.withColumn(
        "_guess", F.least(F.greatest(F.floor((v - low) / width), F.lit(-1)), steps - 1)
    )
    reached = (
        F.when(v.isNull() | F.isnan(v) | low.isNull(), F.lit(0).cast("long"))
        .when(width.isNull(), steps)
        .when((guess >= 0) & above(guess), guess)
        .when((guess + 1 < steps) & ~above(guess + 1), guess + 2)
        .otherwise(guess + 1)
    )
    return with_guess.withColumn(out, reached).drop("_guess")
