"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as a zip through addPyFile."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="parlance-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = os.path.join(folder, "src")
    shutil.copytree(package, os.path.join(copy, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "parlance_package"), "zip", copy))
    _SHIPPED.add(sc.applicationId)
