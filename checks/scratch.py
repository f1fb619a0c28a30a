"""A scratch folder for sessions that name none, as in tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def with_scratch(spark: SparkSession) -> SparkSession:
    """Name a folder of this machine, if the session runs on it alone."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rosterlake-"))
    return spark
