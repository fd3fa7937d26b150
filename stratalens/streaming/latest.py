"""Streams over append-only tables: exactly-once deduplication, running states and incremental hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream; the schema is that of the files there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(rows: DataFrame, keys: list[str], at: str, delay: str = "2 days") -> DataFrame:
    """Each key once, however often it is delivered within the delay; state older than that is dropped."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, at: str, keys: list[str], window: str = "1 day", delay: str = "2 days") -> DataFrame:
    return rows.withWatermark(at, delay).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"))


def hash_misses(rows: DataFrame, cache: DataFrame, path: str) -> DataFrame:
    """Rows of a stream whose path isn't in the (static) cache."""
    return rows.join(cache.select(F.col("path").alias(path)), path, "left_anti")


def drain(rows: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a second run goes on where the first ended."""
    return rows.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
