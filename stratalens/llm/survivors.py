"""One surviving record per duplicate group, chosen by trust, completeness and recency, or built field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_records(df: DataFrame, group: list[str], ranking: list[Column], ident: str) -> DataFrame:
    """The top row of each group by ranking, then by the smallest ident, so the choice never depends on row order.

    The rank filter lets Spark keep one row per group and partition before it shuffles (WindowGroupLimit), so a group
    with a third of all rows arrives as one row per partition. Rows whose group columns are null form their own group;
    rows that tie in ident too are alike for the choice. Empty input gives no rows; other columns pass through.
    """
    window = Window.partitionBy(*group).orderBy(*ranking, F.col(ident).asc_nulls_last())
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") == 1).drop("__rank")


def merged_records(df: DataFrame, group: list[str], ranking: list[Column], ident: str, fields: dict[str, Column]) -> DataFrame:
    """One built record per group: each field from the best-ranked row in which it isn't null; all null gives null.

    ranking holds ascending sort columns (best first) that can be compared as one struct. Aggregates by the rank, which
    combine before the shuffle.
    """
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(ranking)], F.col(ident).alias("ident"))
    picked = [F.min_by(value, F.when(value.isNotNull(), F.col("__rank"))).alias(name) for name, value in fields.items()]
    return df.withColumn("__rank", rank).groupBy(*group).agg(F.min("__rank")["ident"].alias(f"best_{ident}"), F.count("*").alias("n_records"), *picked)
