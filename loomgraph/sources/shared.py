"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a temporary folder, and a cluster is refused."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return set_to or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
