"""Joins whose left side may have a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most this many hot keys, whatever the size of the data.
HOT_KEYS = 1000


def lookup(left: DataFrame, right: DataFrame, keys: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has few rows per key; hot keys of left are looked up in a broadcast table.

    total is the number of rows of left. At most HOT_KEYS keys are broadcast; all others meet in a shuffled join, where
    none of them has more than the share 1 / HOT_KEYS of the rows. left is read three times, so it should be a stored
    table. Null keys match nothing.
    """
    keys = [keys] if isinstance(keys, str) else keys
    known = left.dropna(subset=keys)
    hot = known.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") * HOT_KEYS >= max(total, 100 * HOT_KEYS)).select(*keys)
    hot_right = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    usual = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    return usual.unionByName(left.join(F.broadcast(hot), keys, "left_semi").join(hot_right, keys, how))
