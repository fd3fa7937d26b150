"""Pairs of a still and its short video: by a shared identifier, else by directory and stem."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import normalize_extension, normalize_identifier, parent, path_key, stem
from stratalens.operators.hamming import positions
from stratalens.operators.inventory import STILLS, VIDEOS

PAIR = "still string, video string, identifier string, verified boolean"


def candidates(files: DataFrame, path: str, identifier: str) -> DataFrame:
    """(path, kind, identifier, dir, stem) of stills and videos, each path once."""
    ext = normalize_extension(F.col(path))
    kind = F.when(ext.isin(*STILLS), "still").when(ext.isin(*VIDEOS), "video")
    rows = files.select(F.col(path).alias("path"), kind.alias("kind"), normalize_identifier(F.col(identifier)).alias("identifier"))
    rows = rows.where(F.col("kind").isNotNull()).groupBy("path", "kind").agg(F.min("identifier").alias("identifier"))
    return rows.select("*", parent(F.col("path")).alias("dir"), F.lower(stem(F.col("path"))).alias("stem"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The place of every file, in path order, among those of its key; an identifier may be that of a third of all files."""
    return positions(rows.withColumn("__k", path_key(F.col("path"))), keys, [F.col("__k").asc()]).drop("__k")


def _zip(stills: DataFrame, videos: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th still with the k-th video of each key."""
    right = _numbered(videos, keys).select(*keys, "n", F.col("path").alias("video"))
    return _numbered(stills, keys).withColumnRenamed("path", "still").select(*keys, "n", "still").join(right, [*keys, "n"])


def pairs(found: DataFrame) -> DataFrame:
    """(still, video, identifier, verified): every file in at most one pair.

    Files with one identifier pair up where directory and stem agree, then the rest in path order. What is left pairs
    by directory and stem where at least one side has no identifier; that choice is greedy and depends on the order
    within one directory and stem, so it runs per such bucket (a few files).
    """
    named = found.where(F.col("identifier").isNotNull())
    stills, videos = named.where("kind = 'still'"), named.where("kind = 'video'")
    twins = _zip(stills, videos, ["identifier", "dir", "stem"]).select("still", "video", "identifier")
    free = lambda side, column: side.join(twins.select(F.col(column).alias("path")), "path", "left_anti")
    others = _zip(free(stills, "still"), free(videos, "video"), ["identifier"]).select("still", "video", "identifier")
    verified = twins.unionByName(others)
    used = verified.select(F.col("still").alias("path")).unionByName(verified.select(F.col("video").alias("path")))
    left = found.join(used, "path", "left_anti")
    # only buckets that hold both kinds go to Python
    both = left.groupBy("dir", "stem").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).where("lo <> hi").select("dir", "stem")
    left = left.join(both, ["dir", "stem"], "left_semi")
    loose = left.groupBy("dir", "stem").applyInPandas(_greedy, PAIR)
    return verified.withColumn("verified", F.lit(True)).unionByName(loose)


def _greedy(bucket: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(bucket.itertuples(index=False), key=lambda r: r.path.split("/"))
    videos = [r for r in rows if r.kind == "video"]
    out = []
    for still in (r for r in rows if r.kind == "still"):
        match = next((v for v in videos if still.identifier is None or v.identifier is None), None)
        if match is not None:
            videos.remove(match)
            out.append((still.path, match.path, None, False))
    return pd.DataFrame(out, columns=["still", "video", "identifier", "verified"])


def orphans(found: DataFrame, paired: DataFrame) -> DataFrame:
    """The stills and videos in no pair."""
    used = paired.select(F.col("still").alias("path")).unionByName(paired.select(F.col("video").alias("path")))
    return found.join(used, "path", "left_anti").select("path", "kind")


def scan_order(paired: DataFrame) -> DataFrame:
    return paired.orderBy(F.col("verified").desc(), path_key(F.col("still")))
