"""What the physical plans must and must not contain."""

import re

from oracle_check import plan
from pyspark.sql import functions as F

from hitgauge.operators import density, matching, sampling, sweep
from hitgauge.operators.encoding import encode_rows, hashed_token_encoder
from hitgauge.plans import catalog

SF = "/root/testdata/sf0.001"


def scanned_columns(text, table):
    """Columns read by each scan of a table."""
    found = re.findall(rf"Location: \S+ \[[^\]]*{table}\.parquet\](?:.|\n)*?ReadSchema: struct<(.*?)>\n", text)
    return [set(re.findall(r"(\w+):", f)) for f in found]


def test_split_is_a_filter(spark):
    """Sample and remainder are filters on the scan: no join, no sort, no shuffle."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    for side in sampling.split_queries_cache(docs, "doc_id", 100):
        text = plan(side)
        assert "Join" not in text and "Exchange" not in text and "Sort" not in text
        assert scanned_columns(text, "documents") == [{"doc_id", "lang"}]


def test_sweep_reads_its_columns_once_and_shuffles_counts_only(spark):
    swept = sweep.sweep_thresholds(catalog.scored(spark, SF), ["model"])
    text = plan(swept)
    assert scanned_columns(text, "lineitem") == [{"l_linestatus", "l_extendedprice", "l_returnflag"}]
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    # rows are counted per (group, step) before the first exchange
    assert text.count("Exchange hashpartitioning") == 0 or "partial_count" in text


def test_density_counts_before_it_shuffles(spark):
    bins = density.densities(catalog.scored(spark, SF), ["model"])
    assert "lineitem" not in plan(bins)  # only the staged counts are left


def test_match_of_few_queries_scans_the_cache_without_a_shuffle(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries, cache = sampling.split_queries_cache(vecs, "vec_id", 100)
    text = plan(matching.match_top_1(queries, cache, query_id="vec_id", cache_id="vec_id"))
    below = text[text.index("MapInArrow"):]
    assert scanned_columns(text, "embeddings") == [{"vec_id", "embedding"}]
    assert text.count("MapInArrow") >= 1 and "Join" not in below.split("\n\n\n")[0]


def test_encoder_reads_only_id_and_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    encoded = encode_rows(docs, "text", hashed_token_encoder()).select("doc_id", "embedding")
    assert scanned_columns(plan(encoded), "documents") == [{"doc_id", "text"}]


def test_staged_tables_are_broadcast_by_size(spark):
    rows = spark.range(1000).withColumn("run", F.col("id") % 5)
    from hitgauge.staging import attach, stage

    groups = stage(rows.groupBy("run").agg(F.max("id").alias("top")), "groups")
    assert "BroadcastHashJoin" in plan(attach(rows, groups, ["run"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        joined = attach(rows, groups, ["run"])
        assert "SortMergeJoin" in plan(joined) and joined.filter("top >= 995").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
