"""Sending this package to the executors, for sessions whose workers can't import it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once a SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_docwright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="docwright-ship-")
    sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    sc._docwright_shipped = True
