"""Rows delivered again: keep the latest delivery of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; rows that tie in it are ordered by all their columns.

    row_number with a limit of one lets Spark keep one row per key and partition before the shuffle
    (WindowGroupLimit), so a hot key doesn't gather in one task. Null keys form one group.
    """
    ties = [F.col(c) for c, kind in df.dtypes if c not in keys and not kind.startswith(("map", "variant"))]
    window = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") == 1).drop("__rn")
