"""The session that the command line and the tests use; libraries inject their own."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "runlake", **conf: str) -> SparkSession:
    """UTC, naive timestamps, adaptive plans. Other settings come from ``conf`` or the cluster."""
    builder = SparkSession.builder.appName(name)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.timestampType": "TIMESTAMP_NTZ", "spark.sql.adaptive.enabled": "true"}
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_runlake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # else it was imported from a zip that is on the path already
        folder = tempfile.mkdtemp(prefix="runlake-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "runlake_pkg"), "zip", os.path.dirname(package), os.path.basename(package)))  # Spark serves it from here
    sc._runlake_shipped = True
