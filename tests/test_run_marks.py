"""Runs as bitmaps on the rows: same splits and matches as repeated rows, without repeating vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import plan
from pyspark.sql import functions as F

from hitgauge.operators import matching, sampling
from hitgauge.plans import jobs

SF = "/root/testdata/sf0.001"


@given(st.integers(-5, 5000), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=5))
@settings(max_examples=20, deadline=None)
def test_positions_in_tasks_are_those_of_the_plan(spark, seed, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", sampling.seeded_position(seed, "id").alias("p"))
    wanted = {r.id: r.p for r in rows.collect()} if ids else {}
    assert dict(zip(ids, sampling.seeded_positions(seed, np.array(ids, np.int64)).tolist())) == wanted


def marked_rows(spark, log, **options):
    out = set()
    for marks, mark in sampling.bootstrap_marker(sampling.bootstrap_cuts(log, "id", **options)):
        rows = mark(log)
        for column, is_query in ((marks.asked, True), (marks.held, False)):
            found = rows.select("id", F.explode(marks.runs_of(column)).alias("run")).collect()
            out |= {(r.id, r.run, is_query) for r in found}
    return out


@pytest.mark.parametrize("n_runs, ratio, n", [(1, 0.5, 10), (5, 0.8, 50), (3, 1.0, 7), (65, 0.6, 3), (4, 0.1, 60)])
def test_marks_are_the_split(spark, n_runs, ratio, n):
    log = spark.range(500).select((F.col("id") * 7 - 100).alias("id"))
    options = {"n_runs": n_runs, "sample_ratio": ratio, "n_samples": n}
    split = sampling.bootstrap_runs(log, "id", **options).collect()
    assert marked_rows(spark, log, **options) == {(r.id, r.run, r.is_query) for r in split}


def repeated(log, k, **options):
    """The matches by rows that are repeated for each run."""
    rows = sampling.bootstrap_runs(log, "vec_id", **options)
    found = matching.match_top_k(
        rows.filter("is_query"), rows.filter(~F.col("is_query")), query_id="vec_id", cache_id="vec_id", order="cache_pos", by="run", k=k,
    )
    return {(r.run, r.vec_id, r.match_id, r["rank"], round(r.score, 9)) for r in found.collect()}


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("force", [{}, {"broadcast_bytes": 0, "tile_bytes": 20_000}])
@pytest.mark.parametrize("copies", [1, 40])
def test_marked_matches_are_those_of_repeated_rows(spark, k, force, copies):
    log = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    # copies of a few vectors, so that ties go by the order of each run
    log = log.join(log.select((F.col("vec_id") * copies).alias("vec_id"), F.col("embedding").alias("own")), "vec_id", "left")
    first = log.filter("vec_id = 0").select("embedding").first().embedding
    keep = F.when(F.lit(copies) == 1, F.col("embedding")).otherwise(
        F.coalesce("own", F.array(*[F.lit(float(x)) for x in first]).cast("array<float>")))
    log = log.select("vec_id", keep.alias("embedding"))
    options = {"n_runs": 4, "sample_ratio": 0.7, "n_samples": 40}
    ((marks, mark),) = sampling.bootstrap_marker(sampling.bootstrap_cuts(log, "vec_id", **options))
    rows = mark(log)
    found = matching.match_top_k(rows, rows, query_id="vec_id", cache_id="vec_id", marks=marks, k=k, **force)
    assert {(r.run, r.vec_id, r.match_id, r["rank"], round(r.score, 9)) for r in found.collect()} == repeated(log, k, **options)


def test_vectors_are_not_repeated_per_run(spark):
    log = spark.read.parquet(f"{SF}/embeddings.parquet")
    ((marks, mark),) = sampling.bootstrap_marker(sampling.bootstrap_cuts(log, "vec_id"))
    rows = mark(log)
    text = plan(matching.match_top_k(rows, rows, query_id="vec_id", cache_id="vec_id", marks=marks))
    assert "Generate" not in text and "Exchange" not in text[text.index("MapInArrow"):].split("\n\n\n")[0]
    assert text.count("Scan parquet") == 2  # listed and described: one scan


def test_a_failing_run_leaves_the_others(spark, monkeypatch):
    log = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("text", F.col("vec_id").cast("string"))
    real = jobs.match_with_text
    wanted = jobs.bootstrap_matches(log, {"m": "embedding"}, id_col="vec_id", n_runs=3, n_samples=20).collect()

    def failing(queries, cache, text, *, marks, **options):
        bits = {r[0] for r in queries.select(marks.asked).distinct().collect()} - {0}
        if bits != {2}:  # only run 2 alone goes through
            raise ValueError("no")
        return real(queries, cache, text, marks=marks, **options)

    monkeypatch.setattr(jobs, "match_with_text", failing)
    failures = {}
    found = jobs.bootstrap_matches(log, {"m": "embedding"}, id_col="vec_id", n_runs=3, n_samples=20, failures=failures)
    assert sorted(found.collect()) == sorted(r for r in wanted if r.run == 2) and set(failures) == {"m/run_1", "m/run_3"}


@pytest.mark.parametrize("k", [1, 4])
def test_finds_of_many_scan_tasks_are_merged_in_two_steps(spark, k):
    made = spark.range(0, 40_000, 1, 200).select(
        "id", F.array(*[F.sin((F.col("id") + 1) * (i + 1)).cast("float") for i in range(8)]).alias("embedding")
    )
    asked, wanted = made.filter("id < 20"), {}
    vectors = np.array([r.embedding for r in made.orderBy("id").collect()])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    for i in range(20):
        scores = np.round(vectors @ vectors[i], 9)
        wanted[i] = np.lexsort((np.arange(len(scores)), -scores))[:k].tolist()
    found = matching.match_top_k(asked, made, query_id="id", cache_id="id", k=k)
    rows = found.collect()
    assert {i: [r.match_id for r in sorted(rows, key=lambda r: r["rank"]) if r.id == i] for i in range(20)} == wanted
    # 200 tasks give 200 lists of each query; at most 15 of them reach the last merge
    keys = [node for node in plan(found).split("\n") if "hashpartitioning" in node]
    assert any("_list" in x for x in keys) and any("_list" not in x for x in keys)
    partial = matching.merge_scans(_lists(spark, 200, k), k, 200)
    assert partial.count() == 20 * k
    first = matching.merge_best  # rows that the last merge reads
    seen = []
    matching.merge_best = lambda df, k: seen.append(df.count()) or first(df, k)
    try:
        matching.merge_scans(_lists(spark, 200, k), k, 200).collect()
    finally:
        matching.merge_best = first
    assert seen[0] <= 15 * 20 * k < 200 * 20 * k


def _lists(spark, tasks, k):
    rows = spark.range(0, tasks * 20 * k, 1, tasks)
    return rows.select(
        F.lit(0).cast("long").alias("grp"), (F.col("id") % 20).alias("query_id"), F.col("id").alias("ord"),
        F.col("id").alias("match_id"), (F.col("id") / 1e6).alias("score"),
    )
