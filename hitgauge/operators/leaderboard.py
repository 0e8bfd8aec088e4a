"""Statistics over runs and the best model per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitgauge.functions.names import display_dataset, mean_std_text, short_model_name

KEYS = ["dataset", "model"]
# Fixed value: means closer than this share the first place.
TIE = 1e-6


def run_metrics(aucs: DataFrame, overlaps: DataFrame, run_keys: list[str]) -> DataFrame:
    """One row per run with either metric; a run may lack one of them."""
    return aucs.join(overlaps.select(*run_keys, "overlap"), run_keys, "full_outer")


def run_stats(runs: DataFrame, metrics: tuple[str, ...] = ("auc", "overlap"), by: list[str] = KEYS) -> DataFrame:
    """Mean and population deviation of each metric over the runs that have it."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return runs.groupBy(*by).agg(*aggs)


def complete_cells(stats: DataFrame) -> DataFrame:
    """Every dataset with every model of the whole table; missing combinations are NULL.

    The models are few (one report column each) and travel as one array.
    """
    models = stats.agg(F.array_sort(F.collect_set("model")).alias("models"))
    cells = stats.select("dataset").distinct().select(
        "dataset", F.explode(models.scalar()).alias("model")
    )
    return cells.join(stats, KEYS, "left")


def mark_best(stats: DataFrame, metric: str, minimize: bool = False) -> DataFrame:
    """Add ``is_best``: the model's mean equals the best mean of its dataset within the tie."""
    w = Window.partitionBy("dataset")
    best = (F.min if minimize else F.max)(f"{metric}_mean").over(w)
    close = F.abs(F.col(f"{metric}_mean") - best) < TIE
    return stats.withColumn("is_best", F.coalesce(close, F.lit(False)))


def leaderboard_cells(stats: DataFrame, metric: str, minimize: bool = False) -> DataFrame:
    """Long form of a report table: one text cell per dataset and model."""
    cells = mark_best(complete_cells(stats), metric, minimize)
    return cells.select(
        "dataset", "model",
        display_dataset(F.col("dataset")).alias("dataset_title"),
        short_model_name(F.col("model")).alias("model_title"),
        mean_std_text(F.col(f"{metric}_mean"), F.col(f"{metric}_std")).alias("cell"),
        "is_best",
    )


def leaderboard_table(stats: DataFrame, metric: str, models: list[str], minimize: bool = False) -> DataFrame:
    """Datasets as rows, one column per model, the best cell marked with ``*``."""
    cells = leaderboard_cells(stats, metric, minimize).withColumn(
        "cell", F.when(F.col("is_best"), F.concat("cell", F.lit("*"))).otherwise(F.col("cell"))
    )
    wide = cells.groupBy("dataset").pivot("model", models).agg(F.first("cell"))
    shown = [F.coalesce(F.col(f"`{m}`"), F.lit("-")).alias(m) for m in models]
    return wide.select("dataset", *shown).orderBy("dataset")
