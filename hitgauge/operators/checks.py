"""Data-quality queries on inputs and results. Each returns counts of rows and of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_TOLERANCE = 1e-6


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def check_matches(matches: DataFrame, text: str = "text", score: str = "best_scores") -> DataFrame:
    require_columns(matches, [text, "matches", score])
    s = F.col(score)
    bad = s.isNull() | F.isnan(s) | (s < -1 - SCORE_TOLERANCE) | (s > 1 + SCORE_TOLERANCE)
    return matches.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad).alias("n_bad_scores"),
        F.count_if(F.col("matches").isNull()).alias("n_missing_matches"),
    )


def check_hit_ratio(sweep: DataFrame, by: list[str]) -> DataFrame:
    """The hit ratio lies in [0, 1] and never rises with the threshold."""
    r = F.col("cache_hit_ratio")
    before = F.lag("cache_hit_ratio").over(Window.partitionBy(*by).orderBy("threshold_idx"))
    return sweep.withColumn("_before", before).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((r < 0) | (r > 1)).alias("n_out_of_range"),
        F.count_if(r > F.col("_before")).alias("n_rising"),
    )


def check_label_metrics(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Label metrics lie in [0, 1] and the confusion counts add up; NULL metrics are skipped."""
    metrics = ["precision", "recall", "f1_score", "f0_5_score", "f05_chr_score", "accuracy"]
    outside = [F.count_if((F.col(m) < 0) | (F.col(m) > 1)).alias(f"n_bad_{m}") for m in metrics]
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return sweep.groupBy(*by).agg(
        F.count("precision").alias("n_labelled_rows"),
        *outside,
        F.min(total).alias("min_total"),
        F.max(total).alias("max_total"),
    )


def check_expectations(
    matches: DataFrame,
    expectations: DataFrame,
    order: str,
    text: str = "text",
    score: str = "best_scores",
) -> DataFrame:
    """Expected pairs whose first match is related (one text contains the other) but scores too low.

    ``expectations`` has ``query, expected, min_score``; of several equal queries the first counts.
    """
    first = matches.groupBy(F.col(text).alias("query")).agg(
        F.min_by(F.struct("matches", score), order).alias("_m")
    )
    found, wanted = F.lower("_m.matches"), F.lower("expected")
    related = found.contains(wanted) | wanted.contains(found)
    return (
        expectations.join(first, "query")
        .filter(related & (F.col(f"_m.{score}") < F.col("min_score")))
        .select("query", "expected", "min_score", F.col("_m.matches").alias("matches"),
                F.col(f"_m.{score}").alias("score"))
    )
