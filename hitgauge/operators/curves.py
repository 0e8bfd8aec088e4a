"""Areas, resampled curves and ideal curves of sweep tables.

A group of a sweep table has at most ``steps`` rows, so windows over a group stay small however
many groups there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgauge.functions.grids import grid_indices, grid_point
from hitgauge.functions.metrics import ratio

# Fixed value: points of a resampled curve and of an ideal curve.
CURVE_POINTS = 100


def without_last(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Drop the last threshold of every group, where precision is 1 by convention."""
    last = F.max("threshold_idx").over(Window.partitionBy(*by))
    return sweep.withColumn("_last", last).filter(F.col("threshold_idx") < F.col("_last")).drop("_last")


def trapezoid(points: DataFrame, by: list[str], x: str, y: str, order: list[str]) -> DataFrame:
    """Area under y over x per group, rows taken in ``order``; 0 for a single point."""
    w = Window.partitionBy(*by).orderBy(*order)
    steps = points.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_y2": F.col(y) + F.lag(y).over(w)})
    area = F.coalesce(F.sum(F.col("_dx") * F.col("_y2") / 2), F.lit(0.0))
    return steps.groupBy(*by).agg(area.alias("auc"))


def area_under(
    sweep: DataFrame,
    by: list[str],
    x: str = "cache_hit_ratio",
    y: str = "precision",
    drop_last: bool = True,
) -> DataFrame:
    """Area over the observed range, points sorted by hit ratio (also for another ``x``)."""
    points = without_last(sweep, by) if drop_last else sweep
    area = trapezoid(points, by, x, y, ["cache_hit_ratio", "threshold_idx"])
    if not drop_last:
        return area
    # A group of one threshold has no row left; its area is 0.
    groups = sweep.select(*by).distinct()
    same = area.select(*[F.col(k).alias(f"_a_{k}") for k in by], "auc")
    condition = F.lit(True)
    for k in by:
        condition = condition & groups[k].eqNullSafe(same[f"_a_{k}"])
    joined = groups.join(same, condition, "left")
    return joined.select(*[groups[k] for k in by], F.coalesce("auc", F.lit(0.0)).alias("auc"))


def resample(
    points: DataFrame, by: list[str], x: str, y: str, order: list[str], n: int = CURVE_POINTS
) -> DataFrame:
    """``by, grid_i, grid_x, y``: linear interpolation at ``n`` points of [0, 1], flat at both ends.

    Grid points are placed among the data points, and each takes its neighbours from a window.
    """
    data = points.select(
        *by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.struct(*order).alias("_o"),
        F.lit(None).cast("long").alias("grid_i"),
    )
    grid = (
        points.select(*by).distinct()
        .withColumn("grid_i", F.explode(grid_indices(F.lit(n))))
        .withColumn("_x", grid_point(F.lit(0.0), F.lit(1.0), F.lit(n), F.col("grid_i")))
    )
    is_data = F.col("grid_i").isNull()
    point = F.when(is_data, F.struct("_x", "_y"))
    # Data points come before a grid point of the same x, in their own order.
    place = Window.partitionBy(*by).orderBy("_x", F.col("grid_i").asc_nulls_first(), "_o")
    left = F.last(point, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(point, ignorenulls=True).over(place.rowsBetween(0, Window.unboundedFollowing))
    neighbours = data.unionByName(grid, allowMissingColumns=True).withColumns({"_l": left, "_r": right})
    slope = (F.col("_r._y") - F.col("_l._y")) / (F.col("_r._x") - F.col("_l._x"))
    value = (
        F.when(F.col("_l").isNull(), F.col("_r._y"))
        .when(F.col("_r").isNull() | (F.col("_l._x") == F.col("_x")), F.col("_l._y"))
        .otherwise(slope * (F.col("_x") - F.col("_l._x")) + F.col("_l._y"))
    )
    return neighbours.filter(~is_data).select(
        *by, F.col("grid_i").cast("int").alias("grid_i"), F.col("_x").alias("grid_x"), value.alias("y")
    )


def resampled_curves(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Precision on an even hit-ratio grid per run; runs with fewer than two points are left out."""
    kept = without_last(sweep, by)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    usable = kept.withColumn("_n", size).filter(F.col("_n") >= 2)
    curve = resample(usable, by, "cache_hit_ratio", "precision", ["threshold_idx"])
    return curve.withColumnRenamed("y", "precision")


def area_resampled(curves: DataFrame, by: list[str]) -> DataFrame:
    """Area under the resampled curve; both ends are flat, so it differs from :func:`area_under`."""
    return trapezoid(curves, by, "grid_x", "precision", ["grid_i"])


def mean_curves(curves: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation over the runs per grid point (deviation 0 for one run)."""
    mean, std = F.avg("precision"), F.stddev_pop("precision")
    return curves.groupBy(*by, "grid_i").agg(
        F.first("grid_x").alias("grid_x"),
        F.count(F.lit(1)).alias("n_runs"),
        mean.alias("mean_precision"),
        std.alias("std_precision"),
        (mean - std).alias("band_low"),
        (mean + std).alias("band_high"),
    )


def base_rate(sweep: DataFrame, by: list[str], first_by: list[str]) -> DataFrame:
    """Share of positives per group, read from the first row of its first run in ``first_by`` order."""
    first = F.struct(*first_by, "threshold_idx")
    row = F.min_by(F.struct("tp", "fp", "fn", "tn"), first)
    picked = sweep.filter(F.col("tp").isNotNull()).groupBy(*by).agg(row.alias("r"))
    pos = F.col("r.tp") + F.col("r.fn")
    total = pos + F.col("r.fp") + F.col("r.tn")
    return picked.select(*by, ratio(pos, total, 0.0).alias("base_rate"))


def ideal_areas(rates: DataFrame) -> DataFrame:
    """Areas of the two ideal curves; the first is undefined (NULL) for a base rate of 0."""
    b = F.col("base_rate")
    return rates.withColumns(
        {
            "auc_uniform_negatives": F.when(b > 0, b * (1 - F.ln(b))),
            "auc_zero_negatives": b + 0.5 * (1 - b * b),
        }
    )


def _curve(rates: DataFrame, by: list[str], name: str, points: Column) -> DataFrame:
    return rates.select(*by, F.lit(name).alias("curve"), F.posexplode(points).alias("point_i", "p")).select(
        *by, "curve", "point_i", "p.x", "p.y"
    )


def ideal_curves(rates: DataFrame, by: list[str]) -> DataFrame:
    """``by, curve, point_i, x, y`` of both ideal precision curves."""
    b = F.col("base_rate")

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    start = point(F.lit(0.0), F.lit(1.0))
    n = F.lit(CURVE_POINTS)

    def falling(i: Column) -> Column:
        x = grid_point(b, F.lit(1.0), n, i)
        return point(x, F.when(x != 0, b / x))

    uniform = F.concat(F.array(start), F.transform(grid_indices(n), falling))
    zero = F.array(start, point(b, F.lit(1.0)), point(F.lit(1.0), b))
    return _curve(rates, by, "uniform_negatives", uniform).unionByName(
        _curve(rates, by, "zero_negatives", zero)
    )
