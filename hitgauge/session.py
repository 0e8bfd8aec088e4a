"""Making the package importable in Python workers."""

from __future__ import annotations

import functools
import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession


@functools.cache
def _package_zip() -> str:
    package = pathlib.Path(__file__).resolve().parent
    base = pathlib.Path(tempfile.mkdtemp(prefix="hitgauge-zip-")) / "hitgauge"
    return shutil.make_archive(str(base), "zip", root_dir=package.parent, base_dir=package.name)


@functools.cache
def _ship(application_id: str, spark: SparkSession) -> None:
    spark.sparkContext.addPyFile(_package_zip())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Not needed where it is installed on the cluster or was given to ``--py-files``.
    """
    _ship(spark.sparkContext.applicationId, spark)
