"""Tables that a job reads more than once.

A staged table is an ordinary Parquet table in the checkpoint folder that the cluster names in
``spark.checkpoint.dir``. Writing it cuts the lineage (a lost executor re-reads the files instead
of recomputing the job) and gives Catalyst the true size of the table, so a later join broadcasts
it only when the files are below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="hitgauge-stage-")


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's checkpoint folder, or a scratch one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below the stage folder."""
    return f"{stage_root(spark)}/hitgauge/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, per_group: DataFrame, by: list[str]) -> DataFrame:
    """Add the columns of a per-group table to every row of that group (NULL keys match).

    ``per_group`` has one row per group. Without group keys its single row is read by scalar
    subqueries; with keys it is an equi-join whose strategy follows the measured size.
    """
    extra = [c for c in per_group.columns if c not in by]
    if not by:
        row = per_group.select(F.struct(*extra)).scalar()
        return rows.withColumn("_g", row).select(*rows.columns, *[F.col(f"_g.{c}") for c in extra])
    # Fresh names on the joined side keep the condition unambiguous after a self join.
    right = per_group.select(*[F.col(c).alias(f"_g_{c}") for c in by], *extra)
    condition = functools.reduce(
        lambda a, b: a & b, [rows[c].eqNullSafe(right[f"_g_{c}"]) for c in by]
    )
    return rows.join(right, condition, "left").drop(*[f"_g_{c}" for c in by])
