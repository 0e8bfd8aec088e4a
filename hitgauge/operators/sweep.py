"""Threshold sweep: one pass over the scores, whatever the number of thresholds and groups.

The thresholds of a group are an even grid from its lowest score to 1.0. Each row is reduced to the
number of thresholds it reaches, rows are counted by that number (at most ``steps + 1`` rows per
group and task leave the scan), and running sums over the counts give all confusion matrices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgauge.functions.grids import grid_indices, grid_point, grid_step, with_points_reached
from hitgauge.functions.metrics import accuracy, f_beta, hit_ratio, is_hit, precision, recall
from hitgauge.staging import attach, stage

MAX_STEPS = 200
TOP = 1.0

SWEEP_COLUMNS = [
    "threshold", "precision", "recall", "f1_score", "f0_5_score", "f05_chr_score",
    "cache_hit_ratio", "tp", "fp", "fn", "tn", "accuracy",
]
LABEL_METRICS = [c for c in SWEEP_COLUMNS if c not in ("threshold", "cache_hit_ratio")]


def _with_metrics(counted: DataFrame, labelled: bool) -> DataFrame:
    """Add all output metrics to rows with ``_hits``, ``_pos_hits``, ``_neg_hits`` and totals.

    Label metrics are NULL where ``_labelled`` is not true.
    """
    out = counted.withColumn("cache_hit_ratio", hit_ratio(F.col("_hits"), F.col("_total")))
    if not labelled:
        return out.withColumns({m: F.lit(None).cast(_type(m)) for m in LABEL_METRICS})
    known = F.col("_labelled")
    out = out.withColumns(
        {
            "tp": F.when(known, F.col("_pos_hits")),
            "fp": F.when(known, F.col("_neg_hits")),
            "fn": F.when(known, F.col("_pos") - F.col("_pos_hits")),
            "tn": F.when(known, F.col("_neg") - F.col("_neg_hits")),
        }
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns(
        {"precision": precision(tp, fp), "recall": recall(tp, fn), "accuracy": accuracy(tp, fp, fn, tn)}
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns(
        {
            "f1_score": f_beta(p, r, 1.0),
            "f0_5_score": f_beta(p, r, 0.5),
            "f05_chr_score": F.when(known, f_beta(p, F.col("cache_hit_ratio"), 0.5)),
        }
    )


def _type(metric: str) -> str:
    return "long" if metric in ("tp", "fp", "fn", "tn") else "double"


def _label_counts(label: str | None) -> dict[str, Column]:
    """Totals of a group; labels other than 0 and 1 are neither positive nor negative.

    A group in which only some rows have a label is an error.
    """
    total = F.count(F.lit(1))
    if label is None:
        return {"_total": total}
    known = F.count(label)
    partly = F.raise_error(F.lit("some rows of a group have no label")).cast("boolean")
    return {
        "_total": total,
        "_labelled": F.when((known > 0) & (known < total), partly).otherwise(known > 0),
        "_pos": F.count_if(F.col(label) == 1),
        "_neg": F.count_if(F.col(label) == 0),
    }


def sweep_thresholds(
    scored: DataFrame,
    by: list[str] | None = None,
    score: str = "similarity_score",
    label: str | None = "actual_label",
    steps: int = MAX_STEPS,
    extra_metrics: dict[str, Column] | None = None,
) -> DataFrame:
    """``by``, ``threshold_idx`` and the sweep columns for every threshold of every group.

    Without labels (``label=None``, or a group whose labels are all NULL) the label metrics are
    NULL and the hit ratio is still there. ``extra_metrics`` are added last and may use any
    output column.
    """
    by = by or []
    value = F.col(score).cast("double")
    rows = scored.select(*by, value.alias("_s"), *([F.col(label)] if label else []))

    totals = _label_counts(label)
    groups = rows.groupBy(*by).agg(
        *[c.alias(n) for n, c in totals.items()], F.min(F.when(~F.isnan("_s"), F.col("_s"))).alias("_lo")
    )
    top, n_steps = F.lit(TOP), F.col("_steps")
    groups = groups.withColumn(
        "_steps", F.greatest(F.least(F.lit(steps).cast("long"), "_total"), F.lit(1))
    ).withColumn("_step", grid_step(F.col("_lo"), top, n_steps))
    groups = stage(groups, "sweep-groups")

    # A row that reaches _k thresholds is a hit at the indices 0 .. _k - 1.
    reached = with_points_reached(
        attach(rows, groups.select(*by, "_lo", "_step", "_steps"), by),
        "_k", "_s", "_lo", "_step", top, n_steps,
    )
    sums = {"_hits": F.count(F.lit(1))}
    if label:
        sums |= {
            "_pos_hits": F.count_if(F.col(label) == 1),
            "_neg_hits": F.count_if(F.col(label) == 0),
        }
    counted = reached.groupBy(*by, "_k").agg(*[c.alias(n) for n, c in sums.items()])
    grid = groups.withColumn("_i", F.explode(grid_indices(n_steps))).withColumn("_k", F.col("_i") + 1)
    # The frame takes in all rows of the same _k, so the counts of a point reach its grid row.
    reaching = Window.partitionBy(*by).orderBy(F.desc("_k"))
    summed = counted.unionByName(grid, allowMissingColumns=True).withColumns(
        {n: F.coalesce(F.sum(n).over(reaching), F.lit(0).cast("long")) for n in sums}
    )
    points = summed.filter(F.col("_i").isNotNull()).withColumns(
        {
            "threshold_idx": F.col("_i").cast("int"),
            "threshold": grid_point(F.col("_lo"), top, n_steps, F.col("_i")),
        }
    )
    swept = _with_metrics(points, label is not None).select(*by, "threshold_idx", *SWEEP_COLUMNS)
    for name, metric in (extra_metrics or {}).items():
        swept = swept.withColumn(name, metric)
    return swept


def metrics_at(
    scored: DataFrame,
    thresholds: list[float],
    by: list[str] | None = None,
    score: str = "similarity_score",
    label: str | None = "actual_label",
) -> DataFrame:
    """The sweep columns at given thresholds, as conditional counts in one aggregation."""
    by = by or []
    s = F.col(score).cast("double")
    kinds = {"_hits": F.lit(True)}
    if label:
        kinds |= {"_pos_hits": F.col(label) == 1, "_neg_hits": F.col(label) == 0}
    at = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            *[F.count_if(is_hit(s, t) & kind).alias(n) for n, kind in kinds.items()],
        )
        for t in thresholds
    ]
    counted = scored.groupBy(*by).agg(
        *[c.alias(n) for n, c in _label_counts(label).items()], F.array(*at).alias("_at")
    )
    points = counted.select("*", F.inline("_at")).drop("_at")
    return _with_metrics(points, label is not None).select(*by, *SWEEP_COLUMNS)
