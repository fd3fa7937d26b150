"""Access to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.work import sound

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "report_runs", "media_files", "media_metadata", "duplicate_groups", "hashed_files", "duplicate_pairs",
    "sessions", "commands", "eval_items", "review_labels",
)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table, with only the named columns so that the scan reads no more."""
    sound(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
