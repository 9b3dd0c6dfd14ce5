"""The package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from vellum.functions.each import bounded


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each session, where it isn't on their path already, and Arrow batches their bounds."""
    bounded(spark)
    if spark.conf.get("vellum.shipped", "") == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        made = tempfile.mkdtemp(prefix="vellum-code-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        os.makedirs(f"{made}/tree")
        shutil.copytree(f"{root}/vellum", f"{made}/tree/vellum", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{made}/vellum", "zip", f"{made}/tree"))
    spark.conf.set("vellum.shipped", spark.sparkContext.applicationId)
