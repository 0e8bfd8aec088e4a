"""Classification metrics of a cache threshold as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole as DOUBLE, ``empty`` when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole).when(whole == 0, F.lit(empty))


def is_hit(score: Column, threshold: Column | float) -> Column:
    """Whether a score reaches the threshold; NULL and NaN scores are misses."""
    return F.coalesce(~F.isnan(score) & (score >= threshold), F.lit(False))


def hit_ratio(hits: Column, total: Column) -> Column:
    return ratio(hits, total, 0.0)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp, 1.0)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn, 0.0)


def accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return ratio(tp + tn, tp + fp + fn + tn, 0.0)


def f_beta(a: Column, b: Column, beta: float) -> Column:
    """Weighted harmonic mean of two ratios; 0 when both are 0."""
    weight = beta * beta
    return F.when(a + b != 0, (1 + weight) * a * b / (weight * a + b)).when(
        a + b == 0, F.lit(0.0)
    )


def correct_hit_ratio(precision_col: Column, hit_ratio_col: Column) -> Column:
    """Share of all queries that are answered from the cache and answered right."""
    return precision_col * hit_ratio_col
