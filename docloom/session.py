"""A session with the settings that the engine expects; on a cluster, pass none and keep the deployment's."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits skewed joins and merges small partitions; Arrow moves batches to Python.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "docloom", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """more: settings with dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
