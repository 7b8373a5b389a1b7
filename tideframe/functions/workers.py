"""What Python workers need: this package, and batches of a size that fits beside a JVM."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Arrow batches are smaller than Spark's (its default, ours), unless the session sets a size of its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def with_workers(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver did; clusters without a shared home use --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, (usual, ours) in BATCHES.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, ours)
