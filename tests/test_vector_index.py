"""Vector tables with additions and removals."""

import os

import pytest
from oracle_check import plan
from pyspark.sql import functions as F

from hitgauge.plans import jobs
from hitgauge.sources import vector_index

SCHEMA = "key long, id string, text string, embedding array<float>, change int, removed string, row int"


def rows(spark, *keys, text="t"):
    data = [(k, f"cache:{k}", f"{text}{k}", [float(k or 0), 1.0], k, "x", 3) for k in keys]
    return spark.createDataFrame(data, SCHEMA)


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "key long")


def held(spark, path, version=None):
    return sorted([(r.key, r.text) for r in vector_index.read(spark, path, version).collect()], key=str)


def test_versions_by_brute_force(spark, tmp_path):
    """Random changes against a dictionary, every version read again at the end."""
    import random

    draw, path = random.Random(7), str(tmp_path / "index")
    state = {k: f"a{k}" for k in range(20)}
    assert vector_index.create(rows(spark, *state, text="a"), path) == 0
    history = {0: dict(state)}
    for step in range(8):
        some = draw.sample(range(30), 6)
        if step == 4:
            number = vector_index.compact(spark, path)
        elif step % 2:
            number = vector_index.remove(keys(spark, *some, None, some[0]), path)
            state = {k: v for k, v in state.items() if k not in some}
        else:
            number = vector_index.add(rows(spark, *some, text=f"s{step}-"), path)
            state |= {k: f"s{step}-{k}" for k in some}
        history[number] = dict(state)
    for number, wanted in history.items():
        assert held(spark, path, number) == sorted(wanted.items(), key=str)
    assert vector_index.latest(spark, path) == max(history)


def test_cases(spark, tmp_path):
    path = str(tmp_path / "index")
    assert vector_index.versions(spark, path) == {"base": [], "change": []} and vector_index.prune(spark, path) == []
    for missing in (lambda: vector_index.read(spark, path), lambda: vector_index.compact(spark, path),
                    lambda: vector_index.add(rows(spark, 1), path), lambda: vector_index.remove(keys(spark, 1), path)):
        with pytest.raises(ValueError):
            missing()
    vector_index.create(rows(spark, 1, 1, None), path)
    with pytest.raises(ValueError):
        vector_index.create(rows(spark, 1), path)
    with pytest.raises(ValueError):
        vector_index.read(spark, path, 5)
    # columns with the names of the table's own ones, and repeated and missing keys
    (first, *_) = vector_index.read(spark, path).filter("key = 1").collect()
    assert (first.change, first.removed, first.row) == (1, "x", 3)
    vector_index.add(rows(spark), path)
    vector_index.remove(keys(spark), path)
    assert held(spark, path) == [(1, "t1"), (1, "t1"), (None, "tNone")]
    vector_index.add(rows(spark, 2, 2, 1, None, text="n"), path)
    assert held(spark, path) == [(1, "n1"), (2, "n2"), (2, "n2"), (None, "nNone"), (None, "tNone")]
    # other column order, a missing and a further column
    vector_index.add(spark.createDataFrame([("late", 9, 1)], "text string, key int, more int"), path)
    assert vector_index.read(spark, path).columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert (9, "late") in held(spark, path)


def test_lost_writers_do_not_count(spark, tmp_path):
    path = str(tmp_path / "index")
    vector_index.create(rows(spark, 1), path)
    rows(spark, 5).write.parquet(f"{path}/change=1")
    os.remove(f"{path}/change=1/_SUCCESS")
    assert held(spark, path) == [(1, "t1")]
    assert vector_index.add(rows(spark, 2), path) == 2
    assert held(spark, path) == [(1, "t1"), (2, "t2")]
    reader = vector_index.read(spark, path)
    assert vector_index.compact(spark, path) == 3 and reader.count() == 2
    assert vector_index.prune(spark, path) == ["base=0", "change=2"]
    assert held(spark, path) == [(1, "t1"), (2, "t2")]
    assert vector_index.compact(spark, path) == 3


def test_search_equals_a_rebuilt_index(spark, tmp_path):
    docs = spark.range(200).select(
        F.col("id").alias("doc"), F.concat(F.lit("text "), F.col("id")).alias("text"),
        F.array(F.cos(F.col("id")), F.sin(F.col("id"))).cast("array<float>").alias("embedding"),
    )
    path = str(tmp_path / "index")
    jobs.build_index(docs.filter("doc < 150"), id_col="doc", path=path)
    jobs.build_index(docs.filter("doc >= 140"), id_col="doc", path=path)
    vector_index.remove(docs.filter("doc BETWEEN 30 AND 60").select(F.col("doc").alias("key")), path)
    changed = vector_index.read(spark, path)
    rebuilt = jobs.build_index(docs.filter("doc NOT BETWEEN 30 AND 60"), id_col="doc")
    found = [
        sorted(map(tuple, jobs.search_index(docs.limit(50), index, id_col="doc", k=3).collect()))
        for index in (changed, rebuilt)
    ]
    assert found[0] == found[1] and len(found[0]) == 150


def test_base_is_not_shuffled(spark, tmp_path):
    """Few changes: keys are broadcast, vectors stay in their scan; a compacted table is a plain scan."""
    path = str(tmp_path / "index")
    vector_index.create(rows(spark, *range(50)), path)
    vector_index.remove(keys(spark, 3), path)
    text = plan(vector_index.read(spark, path).select("key", "embedding"))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert "row:struct<key:bigint,embedding:array<float>>" in text
    vector_index.compact(spark, path)
    assert "Join" not in plan(vector_index.read(spark, path))
