"""Verdicts that outlive a job: a pair that was judged once is not judged again.

A verdict table is a Parquet folder with one subfolder per job that added to it, so jobs may write and read it at the
same time; what a lost job leaves are whole rows or nothing. Its key is a SHA-256 of the scope (which judge, which
prompt) and of the pair. Only usable verdicts are kept: a pair without an answer is asked again next time. Two jobs that
judge the same pair at the same time add it twice; the earliest answer counts, then the least one.

Cases: NULL texts are values of their own; repeated pairs are judged once and each row gets the answer; an empty table of
pairs adds nothing; the table's folder need not exist; further columns of the pairs stay as they are, but ``response`` is
replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgauge.staging import stage

JudgePairs = Callable[[DataFrame], DataFrame]
PAIR = ("text", "matches")
SCHEMA = "pair_key BINARY, response STRING, judged_at TIMESTAMP"


def pair_key(columns: Sequence[str], scope: str = "") -> Column:
    """32 bytes that stand for a scope and the values of some columns; NULL differs from every text."""
    values = [F.coalesce(F.concat(F.lit("="), F.base64(F.col(c).cast("string").cast("binary"))), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("|", F.base64(F.lit(scope).cast("binary")), *values), 256))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(pair_key, response): one verdict per pair."""
    base = path.rstrip("/")
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "pair_key BINARY, response STRING")
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(base)
    return rows.groupBy("pair_key").agg(F.min(F.struct("judged_at", "response")).alias("v")).select("pair_key", "v.response")


def add_verdicts(verdicts: DataFrame, path: str, columns: Sequence[str] = PAIR, scope: str = "") -> None:
    """Add the usable verdicts of a job to the table, in a folder of their own."""
    usable = verdicts.filter(F.col("response").isNotNull()).select(
        pair_key(columns, scope).alias("pair_key"), "response", F.current_timestamp().alias("judged_at")
    )
    usable.write.parquet(f"{path.rstrip('/')}/job-{uuid.uuid4().hex}")


def remembered(judge: JudgePairs, path: str, scope: str = "", columns: Sequence[str] = PAIR) -> JudgePairs:
    """A judge that asks ``judge`` only for pairs without a verdict in the table at ``path``, and adds what it says.

    It takes the place of the judge in every job. Verdicts are narrow rows (a key of 32 bytes); those of other pairs are
    dropped by a semi join, and a pair's texts meet its verdict by the key alone. The judge must return each pair that it is
    given once, and at least its ``columns`` and ``response``.
    """

    def work(pairs: DataFrame) -> DataFrame:
        spark = pairs.sparkSession
        rest = [c for c in pairs.columns if c.lower() != "response"]
        keyed = stage(pairs.select(pair_key(columns, scope).alias("_pair_key"), *rest), "pairs")
        wanted = keyed.select(F.col("_pair_key").alias("pair_key"))
        known = read_verdicts(spark, path).join(wanted, "pair_key", "left_semi")
        known = stage(known.select(F.col("pair_key").alias("_known_key"), F.col("response").alias("_said")), "known-verdicts")
        same = F.col("_pair_key") == F.col("_known_key")
        asked = keyed.join(known, same, "left_anti").dropDuplicates(["_pair_key"])
        said = stage(judge(asked.select(*rest)), "verdicts")
        add_verdicts(said, path, columns, scope)
        now = said.select(pair_key(columns, scope).alias("_known_key"), F.col("response").alias("_said"))
        return keyed.join(known.unionByName(now), same, "left").select(*rest, F.col("_said").alias("response"))

    return work
