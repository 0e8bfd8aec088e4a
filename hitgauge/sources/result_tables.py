"""Result tables of an evaluation: fixed names and columns, and the results tree of many runs.

Two layouts of the tree are read::

    base/<dataset>/<model>/run_<i>/<time stamp>/<table>     (new)
    base/<dataset>/<model and time stamp>/<table>           (old)

A table is a CSV file or a folder of CSV part files of that name. Runs of one benchmark job are
written as one partitioned Parquet table instead, see :func:`write_runs`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitgauge.functions.names import ORGANISATIONS, model_from_folder
from hitgauge.sources.csv_files import write_csv
from hitgauge.staging import stage

# Names of the result tables.
CHR_MATCHES = "chr_matches.csv"
CHR_SWEEP = "chr_sweep.csv"
MATCHES = "matches.csv"
JUDGED = "llm_as_a_judge_results.csv"
SWEEP = "threshold_sweep_results.csv"

SWEEP_SCHEMA = (
    "threshold DOUBLE, precision DOUBLE, recall DOUBLE, f1_score DOUBLE, f0_5_score DOUBLE, "
    "f05_chr_score DOUBLE, cache_hit_ratio DOUBLE, tp DOUBLE, fp DOUBLE, fn DOUBLE, tn DOUBLE, "
    "accuracy DOUBLE"
)
RUN_KEYS = ["dataset", "model", "run"]

# Path of a table below the base: dataset, folder, (run, stamp,) table, (part file).
_TABLE = "(" + "|".join(t.replace(".", r"\.") for t in (CHR_MATCHES, CHR_SWEEP, MATCHES, JUDGED, SWEEP)) + ")"
_NEW = rf"([^/]+)/([^/]+)/(run_[^/]+)/([^/]+))/{_TABLE}(?:/[^/]*)?$"
_OLD = rf"([^/]+)/([^/]+))/{_TABLE}(?:/[^/]*)?$"


def matches_table(matched: DataFrame, text: str) -> DataFrame:
    return matched.select(text, "matches", F.col("best_scores").cast("double").alias("best_scores"))


def judged_table(judged: DataFrame, text: str) -> DataFrame:
    return judged.select(text, "matches", "similarity_score", "actual_label")


def write_sweep(sweep: DataFrame, output_dir: str, name: str) -> str:
    """Write a one-run sweep, thresholds in order."""
    ordered = sweep.orderBy("threshold_idx").drop("threshold_idx")
    return write_csv(ordered, output_dir, name, single_file=True)


def write_runs(df: DataFrame, path: str) -> None:
    """All runs of a benchmark as one table, a folder per dataset, model and run.

    The rows of a run are brought together first, or every task would add a small file to every run;
    a run that is too large for one task is split by AQE, which sees what the rows measure.
    """
    df.hint("rebalance", *RUN_KEYS).write.mode("overwrite").partitionBy(*RUN_KEYS).parquet(path)


def write_run_tree(sweeps: DataFrame, judged: DataFrame | None, output_dir: str, stamp: str | None) -> None:
    """Write the CSV tables of every run into the results tree, in the old layout without ``stamp``.

    One write per table for all runs: Spark writes a folder per run below a hidden folder of ``output_dir``, and once all
    are complete each is renamed to its place, where it replaces what was there. A sweep is one file, thresholds in order;
    judged rows of a run are brought together, and AQE splits a run that is too large for one task. A NULL in a
    run's keys raises.
    """
    base = output_dir.rstrip("/")
    safe = F.replace("model", F.lit("/"), F.lit("_"))
    parts = ["dataset", safe, *([F.concat(F.lit("run_"), F.col("run").cast("string")), F.lit(stamp)] if stamp else [])]
    place = F.array_join(F.array(*parts), "/")
    complete = F.col("dataset").isNotNull() & F.col("model").isNotNull() & F.col("run").isNotNull()
    place = F.when(complete, place).otherwise(F.raise_error(F.lit("a run has a NULL in its keys")))
    hidden = f"{base}/_writing-{uuid.uuid4().hex}"
    tables = {SWEEP: sweeps} if judged is None else {SWEEP: sweeps, JUDGED: judged}
    for name, df in tables.items():
        rows = df.withColumn("_place", place).drop(*RUN_KEYS)
        if name == SWEEP:
            rows = rows.repartition("_place").sortWithinPartitions("_place", "threshold_idx").drop("threshold_idx")
        else:
            rows = rows.hint("rebalance", "_place")
        write_csv(rows, hidden, name, partition_by=["_place"])
    _move_runs(sweeps.sparkSession, hidden, list(tables), base)


def _move_runs(spark: SparkSession, hidden: str, tables: list[str], base: str) -> None:
    """Rename the written folders ``hidden/<table>/_place=<escaped place>`` to ``base/<place>/<table>``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(hidden).getFileSystem(spark._jsc.hadoopConfiguration())
    for table in tables:
        for found in files.listStatus(path(f"{hidden}/{table}")):
            name = found.getPath().getName()
            if not name.startswith("_place="):
                continue
            target = path(f"{base}/{unquote(name.removeprefix('_place='))}/{table}")
            files.mkdirs(target.getParent())
            files.delete(target, True)
            if not files.rename(found.getPath(), target):
                raise OSError(f"cannot move {found.getPath()} to {target}")
    files.delete(path(hidden), True)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_dir(output_dir: str, dataset: str, model_folder: str, run: int, stamp: str) -> str:
    return f"{output_dir.rstrip('/')}/{dataset}/{model_folder}/run_{run}/{stamp}"


def _file_path() -> Column:
    """Path of a row's file as it was written; the metadata column is URL-encoded."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def _listing(spark: SparkSession, base: str) -> DataFrame:
    """Paths of all files under ``base``; only the listing is read, never the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return files.select(_file_path().alias("path"))


def crawl_runs(
    spark: SparkSession, base: str, organisations: Sequence[str] = ORGANISATIONS
) -> DataFrame:
    """``dataset, model, run, ts, run_path, tables``: the newest attempt of every run in the tree.

    A model folder with ``run_`` folders is read in the new layout only. Folders of the old
    layout are runs of their model if they hold a sweep table.
    """
    paths = _listing(spark, base)
    # scheme, and whatever stands before the base as it was given
    root = rf"^(\w+:/+(?:.*?/)?{re.escape(re.sub(r'^\w+:', '', base).strip('/'))}/"
    new_re, old_re = root + _NEW, root + _OLD

    def fields(pattern: str, names: list[str]) -> list[Column]:
        return [F.regexp_extract("path", pattern, i).alias(n) for i, n in enumerate(names, 1)]

    new = paths.filter(F.col("path").rlike(new_re)).select(
        *fields(new_re, ["run_path", "dataset", "folder", "run", "ts", "table"])
    )
    attempts = new.groupBy("dataset", "folder", "run", "ts", "run_path").agg(
        F.collect_set("table").alias("tables")
    )
    newest = attempts.groupBy("dataset", "folder", "run").agg(
        F.max_by(F.struct("ts", "run_path", "tables"), "ts").alias("a")
    ).select("dataset", "folder", "run", "a.ts", "a.run_path", "a.tables")

    old = (
        paths.filter(F.col("path").rlike(old_re) & ~F.col("path").rlike(new_re))
        .select(*fields(old_re, ["run_path", "dataset", "folder", "table"]))
        .groupBy("dataset", "folder", "run_path").agg(F.collect_set("table").alias("tables"))
        .filter(F.array_contains("tables", SWEEP))
        .select("dataset", "folder", F.col("folder").alias("run"), F.lit("").alias("ts"), "run_path", "tables")
        .join(newest.select("dataset", "folder").distinct(), ["dataset", "folder"], "left_anti")
    )
    found = newest.unionByName(old).select(
        "dataset",
        model_from_folder(F.col("folder"), organisations).alias("model"),
        "run", "ts", "run_path", "tables",
    )
    return stage(found, "runs")  # every reader of the runs would list the tree again


def _read_of_runs(runs: DataFrame, table: str, schema: str) -> DataFrame:
    """Rows of one table of the given runs; runs without that table simply have no rows.

    Only the folders of these runs are opened. Their paths are file listing, which the driver
    holds for every scan; no result row passes through it.
    """
    spark = runs.sparkSession
    having = runs.filter(F.array_contains("tables", table)).select(*RUN_KEYS, "ts", "run_path")
    found = [f"{r.run_path}/{table}" for r in having.select("run_path").collect()]
    rows = spark.createDataFrame([], f"{schema}, _path STRING")
    if found:
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        rows = reader.schema(schema).csv(found).select("*", _file_path().alias("_path"))
    run_path = F.regexp_extract("_path", rf"^(.*)/{table}(?:/[^/]*)?$", 1)
    return rows.withColumn("run_path", run_path).drop("_path").join(having, "run_path")


def read_run_sweeps(runs: DataFrame) -> DataFrame:
    """Sweep rows of the crawled runs, numbered by ``threshold_idx``."""
    order = Window.partitionBy("run_path").orderBy("threshold")
    rows = _read_of_runs(runs, SWEEP, SWEEP_SCHEMA)
    return rows.withColumn("threshold_idx", F.row_number().over(order) - 1)


def read_run_judgements(runs: DataFrame, text: str = "text") -> DataFrame:
    """Judged rows of the crawled runs."""
    schema = f"`{text}` STRING, matches STRING, similarity_score DOUBLE, actual_label INT"
    return _read_of_runs(runs, JUDGED, schema)
