"""Sends this package to the executors, so that functions that run there can import it wherever the session was started."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
