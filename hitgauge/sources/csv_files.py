"""CSV in and out, for local, HDFS and object-store paths alike.

Object stores need nothing here: use an ``s3a://`` path, credentials and server-side encryption
are Hadoop settings (:data:`ENCRYPTED_OUTPUT` is the usual one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from hitgauge.sources.split_csv import read_split_csv

# Hadoop setting for AES256 server-side encryption of everything written to s3a paths.
ENCRYPTED_OUTPUT = {"spark.hadoop.fs.s3a.encryption.algorithm": "AES256"}

# The texts that a CSV reader of the data-frame kind takes for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    null_tokens: list[str] | None = None,
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes.

    Give a schema where it is known: without one Spark reads the files twice to infer the types.
    Texts in ``null_tokens`` become NULL after the read. Spark reads a file with line breaks inside quotes in one
    task; ``split`` reads large ones in many (see :mod:`hitgauge.sources.split_csv`), and without such line breaks
    ``multi_line=False`` does so more cheaply.
    """
    if not path:
        raise ValueError("path must be given")
    if split:
        df = read_split_csv(spark, path, schema)
        return null_missing(df, null_tokens) if null_tokens else df
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return null_missing(df, null_tokens) if null_tokens else df


def null_missing(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Turn the listed texts into NULL in every string column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in texts})


def write_csv(
    df: DataFrame,
    output_dir: str,
    name: str,
    compression: str | None = None,
    single_file: bool = False,
    partition_by: list[str] | None = None,
) -> str:
    """Write ``output_dir/name`` (a folder of part files), replacing what was there.

    ``single_file`` is for report tables of a few hundred rows only.
    """
    if not output_dir or not name:
        raise ValueError("output_dir and name must be given")
    path = f"{output_dir.rstrip('/')}/{name}"
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    writer = writer.option("header", True).option("escape", '"')
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path
