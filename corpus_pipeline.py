"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

``run(spark, sf_dir)`` takes the ``documents`` table through all stages. Each stage works on all rows that
the one before it kept; its result is written as Parquet below ``spark.checkpoint.dir`` and read again.
All stages but the last return the columns of ``documents``.

Cases: NULL, empty and blank texts have no words, so the quality rules reject them; very long texts are read whole in every
stage; of rows that are near or equal, repeated ids included, the one of the smallest id stays (NULL last, then by the text's
hash); sources that are NULL are one source; an empty table goes through all stages and gives no rows. Further columns are
carried along as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitgauge.llm import decontamination, mixing, queries, repetition, simhash
from hitgauge.session import ship_package
from hitgauge.staging import stage

#: Near-duplicates: texts that share 0.8 of their shingles of five words. They differ in about 10 of 64 bits (deviation 3);
#: pairs that meet are pruned from 20 bits on in either half of the fingerprint, and their shingles compared.
NEAR = {"words": 5, "distance": 20, "second": 20, "share": 0.8}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the suffix-array rules."""
    return repetition.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_per_group(docs, **NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: a row per document."""
    return queries.token_digests(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token files", token_files),
]

#: SQL cannot express suffix arrays, fingerprints, alignments or token files; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, work) in enumerate(STAGES, 1):
        docs = work(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs, f"pipeline-{number}")
    return docs
