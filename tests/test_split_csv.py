"""Files with quoted line breaks, cut anywhere, against the reader that takes a file in one task."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitgauge.plans import jobs
from hitgauge.sources import split_csv
from hitgauge.sources.csv_files import read_csv

SCHEMA = "id bigint, text string, note string"
CUTS = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]


@pytest.fixture
def cut(spark):
    before = {k: spark.conf.get(k, None) for k in CUTS}

    def every(size):
        for k, v in zip(CUTS, (str(size), "0", "1")):
            spark.conf.set(k, v)

    yield every
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


SAMPLE = (
    'id,text,"no\nte"\n1,"two\nlines",x\n\n2,plain,"a ""quoted"" word, and\r\n\r\nmore"\n3,in"side,5" disk\n'
    '4,"","\n\n\n"\n5,,"""\n"""\n\n6,"ends in ""\n"",\n",é漢"x\n7,"long ' + "line\n" * 30 + '",end\n8,last,no break'
)


@pytest.mark.parametrize("size", [3, 7, 16, 33, 1000])
def test_cut_anywhere(spark, cut, tmp_path, size):
    (tmp_path / "one.csv").write_bytes(SAMPLE.encode())
    (tmp_path / "two.csv").write_bytes(b"\n\nid,text,note\n9,\"a\nb\",c\n")
    (tmp_path / "three.csv").write_bytes(b'id,text,note\r\n\r\n10,"a\r\nb",c\r\n11,,"d"\r\n')
    wanted = rows_of(read_csv(spark, str(tmp_path), SCHEMA))
    assert len(wanted) == 11, wanted
    cut(size)
    assert rows_of(read_csv(spark, str(tmp_path), SCHEMA, split=True)) == wanted


def test_types_names_and_missing_values(spark, cut, tmp_path):
    (tmp_path / "a.csv").write_text('id,"te\nxt",score,day\n1,"x\ny",1.5,2024-01-02\n2,NA,,2024-02-03\n3,"",7,\n')
    wanted = read_csv(spark, str(tmp_path), null_tokens=["NA"])
    cut(10)
    found = read_csv(spark, str(tmp_path), null_tokens=["NA"], split=True)
    assert found.schema == wanted.schema and rows_of(found) == rows_of(wanted)


def test_a_large_file_is_read_in_many_tasks(spark, cut, tmp_path):
    made = spark.range(3000).select("id", F.concat(F.lit('a "b"\n'), F.repeat(F.lit("w\n"), (F.col("id") % 50).cast("int")), F.lit("end")).alias("text"))
    made.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "log"))
    cut(20_000)
    found = split_csv.csv_records(spark, str(tmp_path / "log")).filter("not header")
    parts = found.select(F.spark_partition_id().alias("p")).distinct().count()
    queries, cache = jobs.load_csv_data(spark, str(tmp_path / "log"), n_samples=100, schema="id bigint, text string", id_col="id", split=True)
    assert parts > 4 and queries.count() == 100 and rows_of(queries.union(cache.drop("cache_pos"))) == rows_of(made)


def simple_ends(line, inside):
    """A state machine of single characters."""
    state = "in" if inside else "start"
    for i, c in enumerate(line):
        if state == "start":
            state = "in" if c == '"' else "start" if c == "," else "plain"
        elif state == "plain":
            state = "start" if c == "," else "plain"
        elif state == "in":
            state = "quote" if c == '"' else "in"
        elif state == "quote":
            state = "in" if c == '"' else "start" if c == "," else "plain"
    return state == "in"


@given(st.text('a",\r', max_size=12), st.booleans())
@settings(max_examples=500)
def test_line_ends(line, inside):
    assert split_csv.ends_inside(line, inside) == simple_ends(line, inside)


def test_starts_of_ranges(spark):
    kinds = [(False, False), (True, True), (False, True), (True, False)]
    files = [random.Random(i).choices(kinds, k=6) for i in range(60)] + [list(x) for x in itertools.product(kinds, repeat=2)]
    rows = [(f"f{i}", 10 * j, a, b, False) for i, f in enumerate(files) for j, (a, b) in enumerate(f)]
    ends = spark.createDataFrame(rows, "file string, block bigint, from_outside boolean, from_inside boolean, blank boolean")
    found = {(r.file, r.block): r.inside for r in split_csv.range_starts(ends).collect()}
    for i, f in enumerate(files):
        state = False
        for j, ends in enumerate(f):
            assert found[f"f{i}", 10 * j] == state
            state = ends[state]
