"""The data behind each chart, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgauge.functions.metrics import correct_hit_ratio
from hitgauge.functions.names import mean_std_text
from hitgauge.operators.curves import (
    area_resampled, area_under, base_rate, ideal_areas, ideal_curves, mean_curves, resampled_curves,
)
from hitgauge.operators.density import densities, mean_densities, overlap
from hitgauge.operators.leaderboard import run_stats


def precision_vs_hit_ratio(sweep: DataFrame, by: list[str]) -> DataFrame:
    return sweep.select(*by, "threshold_idx", "cache_hit_ratio", "precision")


def metrics_over_threshold(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Long form: precision, hit ratio and their product (share of right answers) per threshold."""
    wide = sweep.select(
        *by, "threshold_idx", "threshold", "precision", "cache_hit_ratio",
        correct_hit_ratio(F.col("precision"), F.col("cache_hit_ratio")).alias("correct_hit_ratio"),
    )
    return wide.unpivot(
        [*by, "threshold_idx", "threshold"],
        ["precision", "cache_hit_ratio", "correct_hit_ratio"], "metric", "value",
    )


def hit_ratio_over_threshold(sweep: DataFrame, by: list[str]) -> DataFrame:
    return sweep.select(*by, "threshold_idx", "threshold", "cache_hit_ratio")


def mean_precision_curves(sweeps: DataFrame, by: list[str], run: str = "run") -> DataFrame:
    """Mean curve with its band and the label ``area ± deviation`` per group."""
    curves = resampled_curves(sweeps, [*by, run])
    areas = run_stats(area_resampled(curves, [*by, run]), ("auc",), by)
    label = areas.select(*by, mean_std_text(F.col("auc_mean"), F.col("auc_std")).alias("auc_label"))
    return mean_curves(curves, by).join(label, by)


def ideal_precision_curves(sweeps: DataFrame, by: list[str], first_by: list[str]) -> DataFrame:
    """Both ideal curves per group with base rate and area."""
    rates = ideal_areas(base_rate(sweeps, by, first_by))
    curves = ideal_curves(rates, by).join(rates, by)
    area = F.when(F.col("curve") == "uniform_negatives", F.col("auc_uniform_negatives")).otherwise(
        F.col("auc_zero_negatives")
    )
    return curves.select(*by, "curve", "point_i", "x", "y", "base_rate", area.alias("auc"))


def mean_density_curves(judged: DataFrame, by: list[str], run: str = "run") -> DataFrame:
    """Mean densities with the label ``overlap ± deviation`` per group."""
    bins = densities(judged, [*by, run])
    overlaps = run_stats(overlap(bins, [*by, run]), ("overlap",), by)
    label = overlaps.select(
        *by, mean_std_text(F.col("overlap_mean"), F.col("overlap_std")).alias("overlap_label")
    )
    return mean_densities(bins, by, run).join(label, by)


def class_densities(judged: DataFrame, by: list[str]) -> DataFrame:
    """Densities over the range of the data, with overlap and total variation."""
    bins = densities(judged, by, data_range=True)
    return bins.join(overlap(bins, by).select(*by, "overlap", "total_variation"), by)


def run_areas(sweeps: DataFrame, by: list[str]) -> DataFrame:
    """Area under precision over hit ratio and over recall, every threshold included."""
    over_ratio = area_under(sweeps, by, drop_last=False).withColumnRenamed("auc", "auc_hit_ratio")
    over_recall = area_under(sweeps, by, x="recall", drop_last=False)
    return over_ratio.join(over_recall.withColumnRenamed("auc", "auc_recall"), by)
