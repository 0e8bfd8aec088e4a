"""Threshold metrics, sweeps and summaries against hand values and NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hitgauge.functions.metrics import accuracy, f_beta, precision, recall
from hitgauge.operators import summary
from hitgauge.operators.checks import check_hit_ratio, check_label_metrics
from hitgauge.operators.summary import score_summary
from hitgauge.operators.sweep import SWEEP_COLUMNS, metrics_at, sweep_thresholds

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def scores(spark, values):
    return spark.createDataFrame([(v,) for v in values], "similarity_score double")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "similarity_score double, actual_label int")


def hit_ratios(spark, values, thresholds):
    out = metrics_at(scores(spark, values), thresholds, label=None).collect()
    by_threshold = {r.threshold: r.cache_hit_ratio for r in out}
    return [by_threshold[t] for t in thresholds]


def swept(df, **options):
    return sweep_thresholds(df, **options).orderBy("threshold_idx").collect()


def test_hit_ratio_at_thresholds(spark):
    deciles = [i / 10 for i in range(1, 11)]
    assert hit_ratios(spark, deciles, [0.5, 0.0, 1.0, 1.1]) == [0.6, 1.0, 0.1, 0.0]
    assert hit_ratios(spark, [], [0.5]) == [0.0]
    assert hit_ratios(spark, [0.5] * 4, [0.5, 0.51]) == [1.0, 0.0]
    assert hit_ratios(spark, [0.7], [0.7, 0.8]) == [1.0, 0.0]
    assert hit_ratios(spark, [0.1, 0.5, 0.9], [2.0, -2.0]) == [0.0, 1.0]


def test_nan_and_null_scores_are_counted_misses(spark):
    assert hit_ratios(spark, [float("nan"), None, 0.5, 0.9], [0.5, 0.0]) == [0.5, 0.5]
    rows = swept(scores(spark, [float("nan"), None, 0.5, 0.9]), label=None)
    assert [r.cache_hit_ratio for r in rows] == [0.5, 0.25, 0.25, 0.0]


def test_small_sweeps(spark):
    rows = swept(scores(spark, [0.1, 0.3, 0.5, 0.7, 0.9]), label=None)
    assert len(rows) == 5 and rows[0].cache_hit_ratio == 1.0
    ratios = [r.cache_hit_ratio for r in rows]
    assert ratios == sorted(ratios, reverse=True)

    uniform = swept(scores(spark, [float(x) for x in np.linspace(0, 1, 101)]), label=None)
    assert len(uniform) == 101 and uniform[0].cache_hit_ratio == 1.0
    assert 0.4 < uniform[50].cache_hit_ratio < 0.6
    assert uniform[-1].cache_hit_ratio == pytest.approx(1 / 101)

    single = swept(scores(spark, [0.8]), label=None)
    assert [(r.threshold, r.cache_hit_ratio) for r in single] == [(0.8, 1.0)]
    extreme = swept(scores(spark, [-1.0, -0.5, 0.0, 0.5, 1.0]), label=None)
    assert [r.cache_hit_ratio for r in extreme] == [1.0, 0.8, 0.6, 0.4, 0.2]


def test_grids_that_do_not_ascend(spark):
    assert [r.cache_hit_ratio for r in swept(scores(spark, [1.0, 1.0]), label=None)] == [1.0, 1.0]
    above = swept(scores(spark, [1.0000001] * 3), label=None)
    assert [r.cache_hit_ratio for r in above] == [1.0] * 3
    assert [r.threshold for r in above] == [float(x) for x in np.linspace(1.0000001, 1.0, 3)]


def test_empty_table_gives_one_row(spark):
    (row,) = swept(labelled(spark, []))
    assert row.threshold is None and row.cache_hit_ratio == 0.0 and row.precision is None and row.tp is None


def test_unlabelled_and_partly_labelled(spark):
    rows = swept(labelled(spark, [(0.1, None), (0.9, None)]))
    assert all(r.precision is None and r.tp is None and r.accuracy is None for r in rows)
    assert [r.cache_hit_ratio for r in rows] == [1.0, 0.0]
    with pytest.raises(PySparkException, match="no label"):
        swept(labelled(spark, [(0.1, None), (0.9, 1)]))


def test_metric_guards(spark):
    zero, one, b = F.lit(0), F.lit(1), F.lit(0.0)
    row = spark.range(1).select(
        precision(zero, zero).alias("p"), recall(zero, zero).alias("r"),
        accuracy(zero, zero, zero, zero).alias("a"), f_beta(b, b, 0.5).alias("f"),
        precision(one, one).alias("half"), f_beta(F.lit(0.5), F.lit(1.0), 1.0).alias("f1"),
    ).first()
    assert (row.p, row.r, row.a, row.f, row.half) == (1.0, 0.0, 0.0, 0.0, 0.5)
    assert row.f1 == pytest.approx(2 / 3)


def test_hand_computed_sweep(spark):
    rows = swept(labelled(spark, [(0.2, 0), (0.4, 1), (0.6, 0), (0.8, 1)]))
    assert list(rows[0].asDict()) == ["threshold_idx", *SWEEP_COLUMNS]
    assert [(r.tp, r.fp, r.fn, r.tn) for r in rows] == [(2, 2, 0, 0), (1, 1, 1, 1), (1, 0, 1, 2), (0, 0, 2, 2)]
    assert [r.precision for r in rows] == [0.5, 0.5, 1.0, 1.0]
    assert [r.recall for r in rows] == [1.0, 0.5, 0.5, 0.0]
    assert rows[2].f05_chr_score == pytest.approx(1.25 * 1.0 * 0.25 / (0.25 * 1.0 + 0.25))


SCORE = st.one_of(st.floats(-1, 1, allow_nan=False, width=32), st.sampled_from([0.25, 0.5, 1.0, 0.29]))


@SLOW
@given(st.lists(st.tuples(SCORE, st.integers(0, 1)), min_size=1, max_size=300))
def test_sweep_equals_rescanning(spark, rows):
    values = np.array([r[0] for r in rows], dtype=float)
    labels = np.array([r[1] for r in rows])
    got = swept(labelled(spark, [(float(s), int(y)) for s, y in rows]))
    expected = np.linspace(values.min(), 1.0, max(min(200, len(values)), 1))
    assert [r.threshold for r in got] == [float(t) for t in expected]
    for r, t in zip(got, expected):
        hit = values >= t
        assert (r.tp, r.fp) == ((hit & (labels == 1)).sum(), (hit & (labels == 0)).sum())
        assert (r.fn, r.tn) == ((~hit & (labels == 1)).sum(), (~hit & (labels == 0)).sum())
        assert r.cache_hit_ratio == hit.sum() / len(values)


def test_groups_with_null_keys_are_kept(spark):
    rows = [(None, 0.5, 1), (None, 0.7, 0), (1, 0.2, 1)]
    df = spark.createDataFrame(rows, "run int, similarity_score double, actual_label int")
    out = sweep_thresholds(df, ["run"]).groupBy("run").count().collect()
    assert sorted((r[0] is None, r["count"]) for r in out) == [(False, 1), (True, 2)]


def test_extra_metric(spark):
    df = labelled(spark, [(0.2, 0), (0.8, 1)])
    out = sweep_thresholds(df, extra_metrics={"miss_ratio": 1 - F.col("cache_hit_ratio")})
    assert sorted(r.miss_ratio for r in out.collect()) == [0.0, 1.0]


@SLOW
@given(st.lists(SCORE, min_size=1, max_size=200))
def test_summary_equals_numpy(spark, values):
    row = score_summary(scores(spark, [float(v) for v in values])).first()
    assert row.n == len(values)
    assert (row.min_score, row.max_score) == (min(values), max(values))
    assert row.mean_score == pytest.approx(np.mean(values), abs=1e-9)
    assert row.median_score == float(np.median(np.array(values, dtype=float)))


@pytest.mark.parametrize("rank_limit", [1_000_000, 10])
def test_median_of_many_rows_with_hot_values(spark, monkeypatch, rank_limit):
    """Beyond the exact range of the sketch, with and without narrowing; a third share one score."""
    monkeypatch.setattr(summary, "RANK_LIMIT", rank_limit)
    n = 300_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise((F.hash("id") % 100_000) / 100_000).alias("similarity_score")
    )
    values = np.array([r[0] for r in df.collect()])
    assert score_summary(df).first().median_score == float(np.median(values))
    halves = score_summary(df.withColumn("side", F.col("similarity_score") > 0.3), ["side"]).collect()
    for row in halves:
        part = values[(values > 0.3) == row.side]
        assert row.median_score == float(np.median(part))


def test_brackets_narrow_until_they_fit(spark, monkeypatch):
    """Scores packed in one bin, and two far clusters with the middle between them."""
    monkeypatch.setattr(summary, "RANK_LIMIT", 50)
    rng = np.random.default_rng(4)
    packed = 0.5 + rng.random(20_000) * 1e-9
    packed[:2] = 0.0, 1.0
    apart = np.r_[rng.random(10_000) * 1e-6, 1 - rng.random(10_000) * 1e-6]
    for values in (packed, apart, np.r_[apart, 0.5], np.full(20_000, 0.25)):
        inside, seen = summary._most_inside, []
        monkeypatch.setattr(summary, "_most_inside", lambda b: seen.append(inside(b)) or seen[-1])
        row = score_summary(scores(spark, values.tolist())).first()
        monkeypatch.setattr(summary, "_most_inside", inside)
        assert row.median_score == float(np.median(values)) and seen[-1] <= 50


def test_summary_with_nan(spark):
    row = score_summary(scores(spark, [0.1, float("nan"), 0.5])).first()
    assert all(np.isnan(row[c]) for c in ("min_score", "max_score", "mean_score", "median_score"))


def test_checks_find_violations(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.5, 0.5, 0.1, 0.1, 0.1, 0.1, 2.0, 1, 1, 0, 0), (1, 1, 0.7, 0.5, 0.1, 0.1, 0.1, 0.1, 0.9, 1, 0, 0, 0)],
        "run int, threshold_idx int, cache_hit_ratio double, precision double, recall double, f1_score double,"
        "f0_5_score double, f05_chr_score double, accuracy double, tp long, fp long, fn long, tn long",
    )
    assert check_hit_ratio(df, ["run"]).first().n_rising == 1
    row = check_label_metrics(df, ["run"]).first()
    assert (row.n_bad_accuracy, row.n_bad_recall, row.min_total, row.max_total) == (1, 0, 1, 2)
