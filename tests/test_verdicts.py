"""Verdicts kept across jobs."""

import glob

from pyspark.sql import functions as F

from hitgauge.operators.verdicts import add_verdicts, pair_key, read_verdicts, remembered
from hitgauge.plans import jobs

SCHEMA = "text string, matches string"


def counting_judge(asked):
    """Answers yes to equal texts, nothing to "fail"; notes each pair that it is asked for."""

    def judge(pairs):
        asked.append(sorted(map(tuple, pairs.select("text", "matches").collect()), key=str))
        equal = F.when(F.col("text").eqNullSafe(F.col("matches")), "yes").otherwise("no")
        return pairs.withColumn("response", F.when(~F.col("text").eqNullSafe("fail"), equal))

    return judge


def test_known_pairs_are_not_asked(spark, tmp_path):
    asked, path = [], str(tmp_path / "table")
    judge = remembered(counting_judge(asked), path, "prompt 1")
    first = [("a", "a"), ("a", "b"), (None, None), ("a", "b"), ("", None), ("fail", "x")]
    out = judge(spark.createDataFrame(first, SCHEMA)).collect()
    want = {("a", "a"): "yes", ("a", "b"): "no", (None, None): "yes", ("", None): "no", ("fail", "x"): None}
    assert sorted(map(tuple, out), key=str) == sorted([(*p, want[p]) for p in first], key=str)
    assert asked[0] == sorted(set(first), key=str)

    judge(spark.createDataFrame(first[:3], SCHEMA)).collect()
    assert asked[1] == []
    half = [("a", "a"), ("c", "c"), ("fail", "x")]
    out = judge(spark.createDataFrame(half, SCHEMA)).collect()
    assert asked[2] == [("c", "c"), ("fail", "x")] and len(out) == 3
    assert {r.text: r.response for r in out} == {"a": "yes", "c": "yes", "fail": None}
    # another prompt is another question
    remembered(counting_judge(asked), path, "prompt 2")(spark.createDataFrame(half[:1], SCHEMA)).collect()
    assert asked[3] == [("a", "a")]
    assert len(glob.glob(f"{path}/job-*")) == 4


def test_empty_pairs_other_columns_and_clashing_names(spark, tmp_path):
    asked, path = [], str(tmp_path / "table")
    judge = remembered(counting_judge(asked), path)
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([("a", "a", 7, "old", b"k")], SCHEMA + ", judged_at int, response string, pair_key binary")
    (row,) = judge(rows).collect()
    assert (row.judged_at, row.response, bytes(row.pair_key)) == (7, "yes", b"k")


def test_the_earliest_verdict_counts(spark, tmp_path):
    path = str(tmp_path / "table")
    for answer in ("yes", "no"):
        add_verdicts(spark.createDataFrame([("a", "b", answer)], SCHEMA + ", response string"), path)
    assert [r.response for r in read_verdicts(spark, path).collect()] == ["yes"]
    assert read_verdicts(spark, str(tmp_path / "nothing")).count() == 0


def test_keys_tell_pairs_apart(spark):
    pairs = [("a", "b"), ("a|b", ""), ("", "a|b"), (None, "b"), ("-", "b"), ("ab", ""), ("", "ab"), (None, None), ("", "")]
    df = spark.createDataFrame(pairs, SCHEMA)
    keys = [bytes(r[0]) for r in df.select(pair_key(["text", "matches"])).collect()]
    assert len(set(keys)) == len(pairs) and {len(k) for k in keys} == {32}
    other = [bytes(r[0]) for r in df.select(pair_key(["text", "matches"], "other")).collect()]
    assert not set(keys) & set(other)


def test_a_second_evaluation_asks_nothing(spark, tmp_path):
    asked = []
    judge = remembered(counting_judge(asked), str(tmp_path / "table"), "model")
    matched = spark.createDataFrame([("a", "a", 0.9), ("b", "c", 0.4), ("b", "c", 0.4)], SCHEMA + ", best_scores double")
    runs = [jobs.full_evaluation(matched, judge, steps=3) for _ in range(2)]
    assert [len(pairs) for pairs in asked] == [2, 0]
    one, two = (sorted(map(tuple, run.judged.collect())) for run in runs)
    assert one == two and len(one) == 3
