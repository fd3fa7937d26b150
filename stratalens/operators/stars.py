"""Connected components by star contraction, over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.work import Workspace


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) of every edge in either direction."""
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def star_labels(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(x, root) of every end of an edge (u, v): the smallest vertex linked to it, itself included.

    Large-star and small-star steps until nothing changes (Kiveris et al., 2014). The steps before the last one are
    deleted as they become useless; their counts and checksums come with the writing.
    """
    state = ws.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    while True:
        both = both_ways(state)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u > v in every row now
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        step = small.select("e.u", "e.v").where("u <> v").distinct()
        stored, now = ws.save_observed(step, "stars", F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        ws.forget(state)
        state = stored
        if now == seen:
            break
        seen = now
    leaves = state.select(F.col("u").alias("x"), F.col("v").alias("root"))
    return leaves.unionByName(state.select(F.col("v").alias("x"), F.col("v").alias("root")).distinct())
