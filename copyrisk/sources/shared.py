"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a fresh folder, for a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("copyrisk.shared", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="copyrisk-")
        spark.conf.set("copyrisk.shared", found)
    return found.rstrip("/")
