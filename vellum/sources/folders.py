"""The folder that all executors share, and paths in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary one, and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        path = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; each call has its own."""
    return f"{shared_dir(spark)}/vellum/{uuid.uuid4().hex}/{name}"
