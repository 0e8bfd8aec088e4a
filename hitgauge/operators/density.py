"""Score densities of positives and negatives, and how much they overlap.

All rows are reduced to counts per (group, bin) in one aggregation, at most 101 rows per group and
task; everything after that works on the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitgauge.functions.grids import grid_indices, grid_point
from hitgauge.functions.metrics import ratio
from hitgauge.staging import attach, stage

# Fixed value: number of bins of every density.
BINS = 100


def _edge(lo: Column, hi: Column, i: Column) -> Column:
    return grid_point(lo, hi, F.lit(BINS + 1).cast("long"), i)


def with_bin(df: DataFrame, value: str, lo: Column, hi: Column, out: str = "bin") -> DataFrame:
    """Add the bin of ``value``; NULL outside [lo, hi]. The last bin includes ``hi``.

    The quotient may be off by one at an edge, so it is compared with the exact edges.
    """
    v = F.col(value)
    width = (hi - lo) / BINS
    inside = ~F.isnan(v) & (v >= lo) & (v <= hi) & (lo < hi) & (width > 0)
    guess = F.when(inside, F.least(F.floor((v - lo) / width), F.lit(BINS - 1)))
    with_guess = df.withColumn("_guess", guess)
    g = F.col("_guess")
    exact = (
        F.when(v < _edge(lo, hi, g), g - 1)
        .when((g < BINS - 1) & (v >= _edge(lo, hi, g + 1)), g + 1)
        .otherwise(g)
    )
    return with_guess.withColumn(out, exact.cast("int")).drop("_guess")


def _densities(counts: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Dense bins 0..99 per group with centre, width and both densities."""
    grid = groups.withColumn("bin", F.explode(grid_indices(F.lit(BINS)))).withColumn(
        "bin", F.col("bin").cast("int")
    )
    keys = [*by, "bin"]
    zero = F.lit(0).cast("long")
    same = counts.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_p", "_m")
    condition = F.lit(True)
    for k in keys:
        condition = condition & grid[k].eqNullSafe(same[f"_c_{k}"])
    bins = grid.join(same, condition, "left").drop(*[f"_c_{k}" for k in keys])
    left, right = (_edge(F.col("_lo"), F.col("_hi"), F.col("bin").cast("long") + d) for d in (0, 1))
    bins = bins.withColumns(
        {
            "n_pos": F.coalesce("_p", zero),
            "n_neg": F.coalesce("_m", zero),
            "center": (left + right) / 2,
            "width": right - left,
        }
    )
    return bins.withColumns(
        {
            # counts / width / count in range, in this order
            "pos_density": F.when(F.col("_in_pos") > 0, F.col("n_pos") / F.col("width") / F.col("_in_pos")),
            "neg_density": F.when(F.col("_in_neg") > 0, F.col("n_neg") / F.col("width") / F.col("_in_neg")),
        }
    )


def densities(
    scored: DataFrame,
    by: list[str] | None = None,
    score: str = "similarity_score",
    label: str = "actual_label",
    data_range: bool = False,
) -> DataFrame:
    """``by, bin, center, width, n_pos, n_neg, pos_density, neg_density``, 100 bins per group.

    Bins span [0, 1] and scores outside are ignored, or with ``data_range`` the span of the
    group's labelled scores. A class without a score in range has NULL densities.
    """
    by = by or []
    value = F.col(score).cast("double").alias("_s")
    rows = scored.select(*by, value, F.col(label).alias("_y")).filter(F.col("_y").isin(0, 1))
    if data_range:
        valid = F.when(~F.isnan("_s"), F.col("_s"))
        span = stage(
            rows.groupBy(*by).agg(F.min(valid).alias("_lo"), F.max(valid).alias("_hi")), "density-span"
        )
        binned = with_bin(attach(rows, span, by), "_s", F.col("_lo"), F.col("_hi"))
    else:
        binned = with_bin(rows, "_s", F.lit(0.0), F.lit(1.0))
    pos, neg = F.col("_y") == 1, F.col("_y") == 0
    counts = stage(
        binned.groupBy(*by, "bin").agg(F.count_if(pos).alias("_p"), F.count_if(neg).alias("_m")),
        "density-counts",
    )
    in_range = F.col("bin").isNotNull()
    groups = counts.groupBy(*by).agg(
        F.sum(F.when(in_range, F.col("_p")).otherwise(0)).alias("_in_pos"),
        F.sum(F.when(in_range, F.col("_m")).otherwise(0)).alias("_in_neg"),
    )
    if data_range:
        groups = attach(groups, span, by)
    else:
        groups = groups.withColumns({"_lo": F.lit(0.0), "_hi": F.lit(1.0)})
    return _densities(counts.filter(in_range), groups, by).select(
        *by, "bin", "center", "width", "n_pos", "n_neg", "pos_density", "neg_density"
    )


def overlap(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group: overlap coefficient, total variation, the mass of both densities and whether
    ``overlap = 1 - total variation`` holds. NULL where a class is empty."""
    by = by or []
    p, m, w = F.col("pos_density"), F.col("neg_density"), F.col("width")
    both = p.isNotNull() & m.isNotNull()  # least() would skip a NULL
    out = bins.groupBy(*by).agg(
        F.sum(F.when(both, F.least(p, m) * w)).alias("overlap"),
        (F.sum(F.when(both, F.abs(p - m) * w)) * 0.5).alias("total_variation"),
        F.sum(p * w).alias("pos_mass"),
        F.sum(m * w).alias("neg_mass"),
    )
    identity = F.abs(F.col("overlap") - (1 - F.col("total_variation"))) < 1e-6
    return out.withColumn("identity_holds", identity)


def mean_densities(bins: DataFrame, by: list[str], run: str = "run") -> DataFrame:
    """Mean density per bin over the runs of a group in which both classes occur."""
    valid = F.col("pos_density").isNotNull() & F.col("neg_density").isNotNull()
    return bins.filter(valid).groupBy(*by, "bin").agg(
        F.first("center").alias("center"),
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("pos_density").alias("mean_pos_density"),
        F.avg("neg_density").alias("mean_neg_density"),
    )


def positive_share(scored: DataFrame, by: list[str], label: str = "actual_label") -> DataFrame:
    """Rows per class and group, the two sides of the label split."""
    return scored.groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
        ratio(F.count_if(F.col(label) == 1), F.count(F.lit(1)), 0.0).alias("positive_share"),
    )
