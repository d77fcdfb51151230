"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a py-file, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_granary_shipped", None) is None:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="granary-package-")
        made = shutil.make_archive(os.path.join(folder, "granary-package"), "zip", package.parent, package.name)
        sc.addPyFile(made)
        sc._granary_shipped = made
    return spark
