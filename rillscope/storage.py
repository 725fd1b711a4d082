"""Where intermediate files go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that the driver and executors share (``spark.checkpoint.dir``; set here only if unset)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rillscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}"
