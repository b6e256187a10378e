"""Session settings that the Python operators rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package; texts are long, so Arrow batches stay small."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark
