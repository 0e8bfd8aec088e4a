"""Score summary with an exact median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgauge.staging import attach, stage

# The sketch finds a rank up to count / SKETCH_ACCURACY; it is merged from every task, so it is
# kept small and further passes narrow the bracket while that still leaves too many rows.
SKETCH_ACCURACY = 1_000
MARGIN = 4.0 / SKETCH_ACCURACY
# Rows of one group that are ranked together.
RANK_LIMIT = 1_000_000
NARROWING_BINS = 4096


def _ranks(n: Column) -> tuple[Column, Column]:
    """The one or two middle ranks, from 1."""
    return F.floor((n + 1) / 2), F.floor((n + 2) / 2)


def _with_upto(counted: DataFrame, by: list[str], key: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(key).asc_nulls_first())
    upto = F.sum("_c").over(order)
    return counted.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))


def _holds(rank: Column) -> Column:
    return (F.col("_before") < rank) & (rank <= F.col("_upto"))


def _narrow(rows: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Tighter brackets: the bins of the bracket, by their own extreme scores, that hold the middle.

    Where the two middle scores lie in different bins they are the last and the first of their bins.
    ``_inside`` counts the rows of the new bracket that are still to be ranked.
    """
    s, low, high = F.col("_s"), F.col("_low"), F.col("_high")
    width = (high - low) / NARROWING_BINS
    place = F.when(width > 0, F.least(F.floor((s - low) / width), F.lit(NARROWING_BINS - 1))).otherwise(0)
    counted = (
        attach(rows, bounds.drop("_inside"), by).filter(s <= high)
        .withColumn("_bin", F.when(s >= low, place))
        .groupBy(*by, "_bin").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_s").alias("_min"), F.max("_s").alias("_max"),
            F.first("n").alias("n"),
        )
    )
    lower, upper = _ranks(F.col("n"))
    held = [F.max(F.when(_holds(rank), F.struct("_bin", "_min", "_max", "_c"))) for rank in (lower, upper)]
    found = _with_upto(counted, by, "_bin").groupBy(*by).agg(
        F.first("n").alias("n"), held[0].alias("_a"), held[1].alias("_b")
    )
    same = F.col("_a._bin") == F.col("_b._bin")
    return stage(
        found.select(
            *by, "n",
            F.when(same, F.col("_a._min")).otherwise(F.col("_a._max")).alias("_low"),
            F.when(same, F.col("_b._max")).otherwise(F.col("_b._min")).alias("_high"),
            F.when(same, F.col("_a._c")).otherwise(0).alias("_inside"),
        ),
        "median-bracket",
    )


def _most_inside(bounds: DataFrame) -> int:
    """Rows of the fullest bracket that can still be divided."""
    width = (F.col("_high") - F.col("_low")) / NARROWING_BINS
    return bounds.filter((width > 0) & (width < float("inf"))).agg(F.max("_inside")).first()[0] or 0


def score_summary(
    scored: DataFrame, by: list[str] | None = None, score: str = "similarity_score"
) -> DataFrame:
    """``n, min_score, max_score, mean_score, median_score`` per group; NULL scores are ignored.

    NaN propagates to all four numbers. The median is exact and distributed: a quantile sketch
    brackets it, then only the distinct scores inside the bracket are ranked.
    """
    by = by or []
    rows = scored.select(*by, F.col(score).cast("double").alias("_s")).filter(F.col("_s").isNotNull())
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_s").alias("min_score"),
        F.max("_s").alias("max_score"),
        F.avg("_s").alias("mean_score"),
        F.percentile_approx("_s", [0.5 - MARGIN, 0.5 + MARGIN], SKETCH_ACCURACY).alias("_bracket"),
    )
    stats = stage(
        stats.select(
            *by, "n", "min_score", "max_score", "mean_score",
            F.col("_bracket")[0].alias("_low"), F.col("_bracket")[1].alias("_high"),
        ),
        "score-summary",
    )
    bounds = stats.select(*by, "n", "_low", "_high", (F.col("n") * (2 * MARGIN)).cast("bigint").alias("_inside"))
    while _most_inside(bounds) > RANK_LIMIT:
        bounds = _narrow(rows, bounds, by)
    bounds = bounds.drop("_inside")
    near = attach(rows, bounds, by).filter(F.col("_s") <= F.col("_high"))
    # Everything below the bracket becomes one counted row; copies of a score become one row too.
    counted = (
        near.withColumn("_v", F.when(F.col("_s") >= F.col("_low"), F.col("_s")))
        .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(_holds(rank), F.col("_v")))

    lower, upper = _ranks(F.col("n"))
    medians = _with_upto(counted, by, "_v").groupBy(*by).agg(
        ((at(lower) + at(upper)) / 2).alias("_median")
    )
    with_median = attach(stats, medians, by)
    has_nan = F.isnan(F.col("max_score"))  # NaN sorts above every number
    nan = F.lit(float("nan"))
    lost = F.col("_median").isNull() & (F.col("n") > 0)
    median = F.when(
        lost, F.raise_error(F.lit("the sketch did not bracket the median")).cast("double")
    ).otherwise(F.col("_median"))
    return with_median.select(
        *by, "n",
        F.when(has_nan, nan).otherwise(F.col("min_score")).alias("min_score"),
        "max_score",
        "mean_score",
        F.when(has_nan, nan).otherwise(median).alias("median_score"),
    )
