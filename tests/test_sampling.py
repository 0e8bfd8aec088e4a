"""Sizes, disjointness and stability of splits."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hitgauge.operators.sampling import (
    bootstrap_runs, mark_sample, sample_n, seeded_position, split_overlap, split_queries_cache,
)


def log(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("text "), "id").alias("text"))


def order(seed, ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize(
    "rows, n, sizes", [(5, 3, (3, 2)), (3, 10, (3, 0)), (7, 3, (3, 4)), (7, 1, (1, 6)), (7, 100, (7, 0)), (4, 0, (0, 4))]
)
def test_complement_split(spark, rows, n, sizes):
    queries, cache = split_queries_cache(log(spark, rows), "id", n)
    q, c = {r.id for r in queries.collect()}, {r.id for r in cache.collect()}
    assert (len(q), len(c)) == sizes
    assert not q & c and q | c == set(range(rows))
    assert split_overlap(queries, cache, "id").count() == 0


@pytest.mark.parametrize("n, sizes", [(3, (3, 7)), (100, (7, 7)), (1, (1, 7))])
def test_explicit_cache_is_kept_whole(spark, n, sizes):
    queries, cache = split_queries_cache(log(spark, 7), "id", n, log(spark, 7))
    assert (queries.count(), cache.count()) == sizes


@pytest.mark.parametrize("n", [1, 100, 4_999, 19_999])
def test_sample_is_the_head_of_the_seeded_order(spark, n):
    ids = {r.id for r in sample_n(log(spark, 20_000), "id", n, seed=9).collect()}
    assert ids == set(order(9, range(20_000))[:n])


def test_sample_is_stable_across_partitioning(spark):
    a = sample_n(log(spark, 5_000), "id", 500).select("id")
    b = sample_n(log(spark, 5_000).repartition(13), "id", 500).select("id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sample_of_repeated_ids_is_refused(spark):
    """The contract of a sample is exact, so a hot id is an error instead of a wrong size."""
    hot = spark.range(3_000).select(F.when(F.col("id") < 1_000, F.lit(7)).otherwise(F.col("id")).alias("id"))
    n = order(42, set(range(1_000, 3_000)) | {7}).index(7) + 5
    with pytest.raises((ValueError, PySparkException), match="unique"):
        mark_sample(hot, "id", n).count()


def test_cache_position(spark):
    (row,) = spark.range(3, 4).select(seeded_position(42, "id").alias("p")).collect()
    assert row.p == int(hashlib.md5(b"42|3").hexdigest()[:15], 16)


def test_bootstrap_runs(spark):
    rows = bootstrap_runs(log(spark, 1_001), "id", n_runs=3, sample_ratio=0.5, n_samples=50).collect()
    for run in (1, 2, 3):
        universe = order(run, range(1_001))[:500]  # 500.5 rounds half to even
        queries = set(order(run + 1000, universe)[:50])
        mine = [r for r in rows if r.run == run]
        assert {r.id for r in mine} == set(universe)
        assert {r.id for r in mine if r.is_query} == queries
        assert all((r.cache_pos is None) == r.is_query for r in mine)


def test_undersized_universe_gives_no_run(spark):
    assert bootstrap_runs(log(spark, 100), "id", n_samples=80).count() == 0
    assert bootstrap_runs(log(spark, 100), "id", n_samples=79).count() == 5 * 80


def test_whole_log_as_universe(spark):
    rows = bootstrap_runs(log(spark, 50), "id", n_runs=2, sample_ratio=1.0, n_samples=10)
    assert rows.filter("is_query").count() == 20 and rows.count() == 100


def test_bootstrap_runs_of_repeated_ids_raise(spark):
    ids = list(range(1000)) + [7] * 20000
    log = spark.createDataFrame([(i,) for i in ids], "id long")
    with pytest.raises(Exception, match="unique"):
        bootstrap_runs(log, "id").count()
