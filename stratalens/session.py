"""Session settings in one place."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",  # see work.sound()
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(cores), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
