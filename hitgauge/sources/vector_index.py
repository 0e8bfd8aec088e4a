"""A vector table that grows and shrinks: additions and removals on top of a base.

The table is a folder of Parquet folders. ``base=n`` holds all rows of version n, ``change=n`` what version n adds or
removes. A version is the newest base up to it and the changes after that base, so adding a thousand documents to a billion
writes a thousand rows. Searches read the base once and drop its replaced rows by an anti join on narrow keys, which Spark
broadcasts as long as the changes are small; :func:`compact` writes a new base when they no longer are.

A folder counts once Spark's committer has marked it as complete, and complete folders never change: readers may go on while
a version is added or the table compacted, and a job that is lost leaves nothing that counts. Its unfinished folder keeps its
number from being written again, so the next version takes the number after it. One writer at a time.

Cases: an added row replaces all rows of its key in earlier versions, and several rows of one key in one version all stay. Rows
without a key are never replaced or removed, and NULL keys remove nothing. Unknown keys may be removed. A key may come back
after its removal. Empty tables make a version without rows. Added rows are taken by the base's column names and types; missing
columns are NULL, further ones are left out. No column name is reserved but ``key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DONE = "_SUCCESS"


def _folders(spark: SparkSession, path: str, complete: bool = False) -> dict[str, list[int]]:
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    folder = path_of(path.rstrip("/"))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "change": []}
    if files.exists(folder):
        for entry in files.listStatus(folder):
            kind, _, number = entry.getPath().getName().partition("=")
            if kind in found and number.isdigit() and (not complete or files.exists(path_of(entry.getPath(), DONE))):
                found[kind].append(int(number))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def versions(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the complete ``base`` and ``change`` folders, in order; two empty lists where there is no table."""
    return _folders(spark, path, complete=True)


def latest(spark: SparkSession, path: str) -> int | None:
    """The newest version; None where there is no table."""
    found = versions(spark, path)
    return max(found["base"] + found["change"]) if found["base"] else None


def _newest_folder(spark: SparkSession, path: str) -> int:
    """The highest number of any folder, complete or not."""
    return max(n for numbers in _folders(spark, path).values() for n in numbers)


def _write(rows: DataFrame, path: str, kind: str, version: int) -> int:
    """Write a version: the key, whether it is removed, and the whole row."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    marked = rows.select(F.col("key"), F.lit(False).alias("removed"), whole.alias("row"))
    marked.write.parquet(f"{path.rstrip('/')}/{kind}={version}")
    return version


def create(rows: DataFrame, path: str) -> int:
    """Write the first version, from rows with a ``key``; fails where there is a table."""
    spark = rows.sparkSession
    if latest(spark, path) is not None:
        raise ValueError(f"there is a vector table at {path}")
    left = _folders(spark, path)["base"]
    return _write(rows, path, "base", left[-1] + 1 if left else 0)


def _next(spark: SparkSession, path: str) -> int:
    if latest(spark, path) is None:
        raise ValueError(f"no vector table at {path}")
    return _newest_folder(spark, path) + 1


def _base_schema(spark: SparkSession, path: str, base: int):
    return spark.read.parquet(f"{path.rstrip('/')}/base={base}").schema


def add(rows: DataFrame, path: str) -> int:
    """Add rows, or replace those of their keys; returns the new version."""
    spark = rows.sparkSession
    version = _next(spark, path)
    base = versions(spark, path)["base"][-1]
    return _write(rows.to(_base_schema(spark, path, base)["row"].dataType), path, "change", version)


def remove(keys: DataFrame, path: str) -> int:
    """Remove the rows with the keys in the column ``key``; returns the new version."""
    spark = keys.sparkSession
    version = _next(spark, path)
    schema = _base_schema(spark, path, versions(spark, path)["base"][-1])
    gone = keys.select(
        F.col("key").cast(schema["key"].dataType).alias("key"),
        F.lit(True).alias("removed"),
        F.lit(None).cast(schema["row"].dataType).alias("row"),
    ).filter(F.col("key").isNotNull()).distinct()
    gone.write.parquet(f"{path.rstrip('/')}/change={version}")
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of a version (the newest by default), as they were added."""
    root, found = path.rstrip("/"), versions(spark, path)
    newest = latest(spark, path)
    if newest is None:
        raise ValueError(f"no vector table at {path}")
    version = newest if version is None else version
    bases = [n for n in found["base"] if n <= version]
    if version not in found["base"] + found["change"] or not bases:
        raise ValueError(f"version {version} of {path} does not exist")
    schema = _base_schema(spark, path, bases[-1])
    base = spark.read.schema(schema).parquet(f"{root}/base={bases[-1]}")
    later = [n for n in found["change"] if bases[-1] < n <= version]
    if not later:
        return base.select("row.*")
    numbered = T.StructType([*schema.fields, T.StructField("change", T.LongType())])
    changes = spark.read.schema(numbered).option("basePath", root).parquet(
        *[f"{root}/change={n}" for n in later]
    )
    last = changes.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max("change").alias("last"))
    kept = base.join(last.select("key"), "key", "left_anti").select("row")
    renamed = last.withColumnRenamed("key", "_last_key")
    newer = changes.filter(~F.col("removed")).join(renamed, F.col("key") == F.col("_last_key"), "left")
    added = newer.filter(F.col("last").isNull() | (F.col("change") == F.col("last"))).select("row")
    return kept.unionByName(added).select("row.*")


def compact(spark: SparkSession, path: str) -> int:
    """Write the newest version as a base of a new number; what it makes superfluous stays until :func:`prune`."""
    newest = latest(spark, path)
    if newest is None:
        raise ValueError(f"no vector table at {path}")
    if newest not in versions(spark, path)["base"]:
        newest = _write(read(spark, path), path, "base", _next(spark, path))
    return newest


def prune(spark: SparkSession, path: str) -> list[str]:
    """Delete all that the newest version does not need; returns the names of the folders.

    Call it when nobody reads earlier versions any more.
    """
    found = versions(spark, path)
    if not found["base"]:
        return []
    keep = found["base"][-1]
    names = [f"base={n}" for n in found["base"] if n < keep] + [f"change={n}" for n in found["change"] if n <= keep]
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for name in names:
        folder = path_of(f"{path.rstrip('/')}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return names
