"""Areas, resampling, densities and leaderboard against NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitgauge.operators import curves, density, leaderboard

SLOW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def sweep_rows(spark, points, run=1):
    rows = [(run, i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "run int, threshold_idx int, cache_hit_ratio double, precision double")


UNIT = st.integers(0, 40).map(lambda i: i / 40)


@SLOW
@given(st.lists(UNIT, min_size=3, max_size=40), st.integers(0, 5))
def test_resampling_and_areas(spark, xs, seed):
    xs = sorted(xs, reverse=True)
    ys_of = {x: y for x, y in zip(sorted(set(xs)), np.random.default_rng(seed).random(len(set(xs))))}
    points = [(x, ys_of[x]) for x in xs]
    df = sweep_rows(spark, points)
    x = np.array([p[0] for p in points[:-1]])[::-1]
    y = np.array([p[1] for p in points[:-1]])[::-1]
    assert curves.area_under(df, ["run"]).first().auc == pytest.approx(np.trapezoid(y, x), abs=1e-9)
    grid = np.linspace(0, 1, 100)
    expected = np.interp(grid, x, y)
    resampled = curves.resampled_curves(df, ["run"])
    got = resampled.orderBy("grid_i").collect()
    assert [r.grid_x for r in got] == [float(g) for g in grid]
    assert [r.precision for r in got] == pytest.approx(list(expected), abs=1e-9)
    area = curves.area_resampled(resampled, ["run"]).first().auc
    assert area == pytest.approx(np.trapezoid(expected, grid), abs=1e-9)


def test_short_runs(spark):
    one = sweep_rows(spark, [(1.0, 0.5)])
    assert curves.area_under(one, ["run"]).first().auc == 0.0
    assert curves.resampled_curves(one, ["run"]).count() == 0
    two = sweep_rows(spark, [(1.0, 0.5), (0.5, 1.0)])
    assert curves.resampled_curves(two, ["run"]).count() == 0
    assert curves.area_under(two, ["run"], drop_last=False).first().auc == pytest.approx(0.375)


def test_mean_curve_of_one_run_has_no_deviation(spark):
    df = sweep_rows(spark, [(1.0, 0.5), (0.5, 0.7), (0.2, 1.0)])
    bands = curves.mean_curves(curves.resampled_curves(df, ["run"]).withColumn("model", F.lit("m")), ["model"])
    assert bands.count() == 100 and bands.filter("std_precision <> 0").count() == 0


def test_ideal_curves(spark):
    rates = spark.createDataFrame([(1, 0.25), (2, 0.0), (3, 1.0)], "g int, base_rate double")
    areas = {r.g: r for r in curves.ideal_areas(rates).collect()}
    assert areas[1].auc_uniform_negatives == pytest.approx(0.25 * (1 - np.log(0.25)))
    assert areas[1].auc_zero_negatives == pytest.approx(0.25 + 0.5 * (1 - 0.0625))
    assert areas[2].auc_uniform_negatives is None and areas[3].auc_uniform_negatives == 1.0
    points = curves.ideal_curves(rates.filter("g = 1"), ["g"]).collect()
    uniform = sorted((p.point_i, p.x, p.y) for p in points if p.curve == "uniform_negatives")
    assert len(uniform) == 101 and uniform[0][1:] == (0.0, 1.0) and uniform[1][1:] == (0.25, 1.0)
    assert uniform[100][1:] == (1.0, 0.25)
    zero = sorted((p.point_i, p.x, p.y) for p in points if p.curve == "zero_negatives")
    assert [z[1:] for z in zero] == [(0.0, 1.0), (0.25, 1.0), (1.0, 0.25)]


def judged(spark, rows):
    return spark.createDataFrame([(1, float(s), int(y)) for s, y in rows], "run int, similarity_score double, actual_label int")


EDGES = [i * 0.01 for i in range(101)] + [i / 100 for i in range(101)] + [-0.1, 1.2, 0.0, 1.0, 0.29]


def histograms(rows, edges):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return [np.histogram(v, bins=edges)[0] for v in (pos, neg)]


@SLOW
@given(st.lists(st.tuples(st.one_of(st.sampled_from(EDGES), st.floats(-0.5, 1.5)), st.integers(0, 1)),
                min_size=2, max_size=200))
def test_fixed_bins_equal_numpy(spark, rows):
    edges = np.linspace(0, 1, 101)
    pos, neg = histograms(rows, edges)
    out = density.densities(judged(spark, rows), ["run"]).orderBy("bin").collect()
    assert [r.n_pos for r in out] == list(pos) and [r.n_neg for r in out] == list(neg)
    if pos.sum() and neg.sum():
        p, n = pos / np.diff(edges) / pos.sum(), neg / np.diff(edges) / neg.sum()
        assert [r.pos_density for r in out] == pytest.approx(list(p))
        lap = density.overlap(density.densities(judged(spark, rows), ["run"]), ["run"]).first()
        assert lap.overlap == pytest.approx(np.sum(np.minimum(p, n) * np.diff(edges)))
        assert lap.identity_holds


@SLOW
@given(st.lists(st.tuples(st.floats(-1, 1, width=32), st.integers(0, 1)), min_size=2, max_size=200))
def test_data_range_bins_equal_numpy(spark, rows):
    values = [s for s, _ in rows]
    out = density.densities(judged(spark, rows), ["run"], data_range=True).orderBy("bin").collect()
    if (max(values) - min(values)) / 100 == 0:
        assert all(r.n_pos == r.n_neg == 0 for r in out)
        return
    pos, neg = histograms(rows, np.linspace(min(values), max(values), 101))
    assert [r.n_pos for r in out] == list(pos) and [r.n_neg for r in out] == list(neg)


def test_one_class_has_no_overlap(spark):
    bins = density.densities(judged(spark, [(0.1, 1), (0.2, 1)]), ["run"])
    row = density.overlap(bins, ["run"]).first()
    assert row.overlap is None and row.total_variation is None and row.pos_mass == pytest.approx(1.0)
    assert density.mean_densities(bins, ["run"]).count() == 0


def test_leaderboard_fills_missing_cells_and_marks_ties(spark):
    rows = [("a", "x", 1, 0.5), ("a", "x", 2, 0.7), ("a", "y", 1, 0.6000000001), ("b", "x", 1, 0.4)]
    runs = spark.createDataFrame(rows, "dataset string, model string, run int, auc double").withColumn(
        "overlap", F.lit(None).cast("double")
    )
    stats = leaderboard.run_stats(runs)
    by = {(r.dataset, r.model): r for r in stats.collect()}
    assert by["a", "x"].auc_mean == pytest.approx(0.6) and by["a", "x"].auc_std == pytest.approx(0.1)
    assert by["b", "x"].auc_std == 0.0 and by["a", "x"].overlap_mean is None
    cells = {(r.dataset, r.model): r for r in leaderboard.leaderboard_cells(stats, "auc").collect()}
    assert len(cells) == 4
    assert cells["b", "y"].cell == "-" and not cells["b", "y"].is_best
    assert cells["a", "x"].is_best and cells["a", "y"].is_best and cells["a", "x"].cell == "0.600 ± 0.100"
    table = {r.dataset: r for r in leaderboard.leaderboard_table(stats, "auc", ["x", "y"]).collect()}
    assert table["b"]["y"] == "-" and table["b"]["x"] == "0.400 ± 0.000*"


def test_runs_without_one_metric_are_kept(spark):
    aucs = spark.createDataFrame([("d", "m", 1, 0.5)], "dataset string, model string, run int, auc double")
    laps = spark.createDataFrame([("d", "m", 2, 0.1)], "dataset string, model string, run int, overlap double")
    keys = ["dataset", "model", "run"]
    row = leaderboard.run_stats(leaderboard.run_metrics(aucs, laps, keys)).first()
    assert (row.n_runs, row.auc_mean, row.overlap_mean) == (2, 0.5, 0.1)
