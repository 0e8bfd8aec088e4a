"""Verdicts, labels and the judge hook."""

import pytest
from pyspark.sql import functions as F

from hitgauge.operators.checks import check_expectations, check_matches, require_columns
from hitgauge.operators.judging import failure_count, first_verdicts, judge_pairs, label_pairs, verdict_label

KEYS = ["text", "matches"]


def matched(spark, rows):
    return spark.createDataFrame(rows, "text string, matches string, best_scores double")


def verdicts(spark, rows):
    return spark.createDataFrame(rows, "text string, matches string, response string, seq int")


def test_first_verdict_wins_and_missing_is_negative(spark):
    queries = matched(spark, [("a", "x", 0.9), ("a", "x", 0.8), ("b", "y", 0.7), ("c", "z", 0.6)])
    judged = verdicts(spark, [("a", "x", "yes", 1), ("a", "x", "no", 2), ("b", "y", None, 1), ("b", "y", "yes", 3)])
    rows = label_pairs(queries, judged, KEYS, "seq").collect()
    assert sorted((r.text, r.similarity_score, r.actual_label) for r in rows) == [
        ("a", 0.8, 1), ("a", 0.9, 1), ("b", 0.7, 1), ("c", 0.6, 0),
    ]
    kept = label_pairs(queries, judged, KEYS, "seq", drop_failed=True).collect()
    assert sorted(r.text for r in kept) == ["a", "a", "b"]


def test_null_keys_join(spark):
    queries = matched(spark, [(None, "x", 0.9), ("a", None, 0.5)])
    judged = verdicts(spark, [(None, "x", "yes", 1), ("a", None, "yes", 1)])
    assert [r.actual_label for r in label_pairs(queries, judged, KEYS, "seq").collect()] == [1, 1]


def test_existing_label_columns_do_not_clash(spark):
    queries = matched(spark, [("a", "x", 0.9)]).withColumns(
        {"similarity_score": F.lit(0.1), "actual_label": F.lit(7), "response": F.lit("old")}
    )
    (row,) = label_pairs(queries, verdicts(spark, [("a", "x", "yes", 1)]), KEYS, "seq").collect()
    assert (row.similarity_score, row.actual_label) == (0.9, 1)


def test_only_the_exact_answer_is_positive(spark):
    df = spark.createDataFrame([("yes",), ("Yes",), (" yes",), ("no",), (None,)], "r string")
    assert [r[0] for r in df.select(verdict_label(F.col("r"))).collect()] == [1, 0, 0, 0, 0]


def test_judge_failures_do_not_stop_other_pairs(spark):
    def load_picky_judge():
        def judge(pairs, prompt):
            if any(a == "boom" for a, _ in pairs):
                raise RuntimeError("model crashed")
            return [None if a == "skip" else f"{prompt}{'YES' if a == b else 'NO'}" for a, b in pairs]

        return judge

    pairs = matched(spark, [("A", "a", 1.0), ("b", "x", 0.5), ("boom", "x", 0.5), ("skip", "x", 0.5)]).coalesce(1)
    out = judge_pairs(
        pairs, load_picky_judge, prompt="> ", preprocess=F.lower,
        postprocess=lambda c: F.lower(F.substring(c, 3, 10)),
    )
    got = {r.text: (r.response, r.error) for r in out.collect()}
    assert got == {
        "A": ("yes", None), "b": ("no", None), "boom": (None, "model crashed"), "skip": (None, "no answer"),
    }
    row = failure_count(out).first()
    assert (row.n_pairs, row.n_failed) == (4, 2)


def test_hot_pair(spark):
    """A third of all queries share one pair, and so do their verdicts."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"),
        F.lit("m").alias("matches"), F.lit(0.5).alias("best_scores"), "id",
    )
    judged = rows.select("text", "matches", F.lit("yes").alias("response"), F.col("id").alias("seq"))
    assert first_verdicts(judged, KEYS, "seq").count() == 20_001
    assert label_pairs(rows, judged, KEYS, "seq").agg(F.sum("actual_label")).first()[0] == 30_000


def test_match_checks(spark):
    row = check_matches(matched(spark, [("a", "x", 1.0000001), ("b", None, 1.1), ("c", "y", float("nan"))])).first()
    assert (row.n_rows, row.n_bad_scores, row.n_missing_matches) == (3, 2, 1)
    with pytest.raises(ValueError, match="best_scores"):
        require_columns(matched(spark, []).drop("best_scores"), ["best_scores"])


def test_expectations(spark):
    found = spark.createDataFrame(
        [(1, "q1", "The Cat sat", 0.4), (2, "q1", "dog", 0.9), (3, "q2", "cat", 0.95), (4, "q3", "bird", 0.1)],
        "id int, text string, matches string, best_scores double",
    )
    wanted = spark.createDataFrame(
        [("q1", "cat", 0.5), ("q2", "a cat here", 0.5), ("q3", "fish", 0.5)],
        "query string, expected string, min_score double",
    )
    (row,) = check_expectations(found, wanted, "id").collect()
    assert (row.query, row.matches, row.score) == ("q1", "The Cat sat", 0.4)


def test_full_evaluation_asks_the_judge_once_per_pair(spark, tmp_path):
    """The judge hook as it is, without an order of verdicts; a pair that many queries share is asked once."""
    from hitgauge.plans import jobs

    rows = [("a", "x", 0.9), ("a", "x", 0.9), ("b", "y", 0.5), ("c", "z", 0.2)]
    matched = spark.createDataFrame(rows, "text string, matches string, best_scores double")
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        def judge(pairs, prompt):
            for _ in pairs:
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return [None if a == "c" else prompt for a, _ in pairs]

        return judge

    done = jobs.full_evaluation(matched, lambda p: judge_pairs(p, load, prompt="YES", postprocess=F.lower))
    labels = sorted((r.text, r.similarity_score, r.actual_label) for r in done.judged.collect())
    assert labels == [("a", 0.9, 1), ("a", 0.9, 1), ("b", 0.5, 1), ("c", 0.2, 0)]
    assert len(list(tmp_path.iterdir())) == 3
    done.sweep.count()
    assert len(list(tmp_path.iterdir())) == 3


def test_scores_are_not_rounded_unless_asked(spark):
    from hitgauge.plans import jobs

    q = spark.createDataFrame([(1, "q", [1.0, 0.0])], "id long, text string, embedding array<float>")
    c = spark.createDataFrame([(2, "c", [0.79999965, 0.6000004666])], "id long, text string, embedding array<float>")
    full = jobs.run_matching(q, c, id_col="id", vector="embedding", order="id").first().best_scores
    cut = jobs.run_matching(q, c, id_col="id", vector="embedding", order="id", score_digits=6).first().best_scores
    assert full < 0.8 <= cut
