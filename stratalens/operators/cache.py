"""The hash cache: a table of (path, algorithm, mtime, size, hash) with one row per path and algorithm."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions.numbers import ratio
from stratalens.schemas import SCHEMAS
from stratalens.work import SharedFiles

KEY = ["path", "algorithm"]
FULL = [*KEY, "mtime", "size"]


def lookup(wanted: DataFrame, cache: DataFrame, valid: Column | None = None) -> DataFrame:
    """wanted with hash and hit; a hit agrees in path, algorithm, mtime and size, and its hash is well-formed."""
    found = wanted.join(cache.select(*FULL, "hash"), FULL, "left")
    ok = F.col("hash").isNotNull() & (valid if valid is not None else F.lit(True))
    return found.withColumn("hit", F.coalesce(ok, F.lit(False))).withColumn("hash", F.when(F.col("hit"), F.col("hash")))


def upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries (and their order in column ord) written over it; the last entry of a key wins."""
    columns = [*FULL, "hash"]
    both = cache.select(*columns, F.lit(None).cast("bigint").alias("ord")).unionByName(entries.select(*columns, F.col("ord").cast("bigint").alias("ord")))
    window = Window.partitionBy(*KEY).orderBy(F.col("ord").desc_nulls_last(), F.col("mtime").desc(), F.col("hash"))
    return both.withColumn("rn", F.row_number().over(window)).where("rn = 1").select(*columns)


def stale(cache: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries whose path isn't in a fresh listing."""
    return cache.join(listing.select("path").distinct(), "path", "left_anti")


def prune(cache: DataFrame, listing: DataFrame) -> DataFrame:
    return cache.join(listing.select("path").distinct(), "path", "left_semi")


def clear(cache: DataFrame) -> DataFrame:
    """The cache without entries."""
    return cache.limit(0)


def stats(looked_up: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: entries, distinct paths, hits, misses, hit_rate (0 without lookups)."""
    lookups = looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return cache.agg(F.count("*").alias("entries"), F.count_distinct("path").alias("paths")).crossJoin(lookups).withColumn("hit_rate", ratio(F.col("hits"), F.col("hits") + F.col("misses")))


def batch(files: DataFrame, hashers: dict[str, str], cache: DataFrame, compute, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Cache-first hashing: (outcomes in input order, cache entries to write).

    files: ord, path, media_type, mtime, size, content. hashers names the algorithm per media type; compute(content) is
    a column with the hash, or null on failure. Status is cached, hashed, failed, or skipped without a hasher.
    """
    algorithm = F.create_map(*[F.lit(x) for kv in sorted(hashers.items()) for x in kv])[F.col("media_type")] if hashers else F.lit(None).cast("string")
    tagged = files.withColumn("algorithm", algorithm)
    looked = lookup(tagged.where(F.col("algorithm").isNotNull()), cache, valid)
    done = looked.withColumn("digest", F.when(F.col("hit"), F.col("hash")).otherwise(compute(F.col("content"))))
    status = F.when(F.col("hit"), "cached").when(F.col("digest").isNull(), "failed").otherwise("hashed")
    outcomes = done.select("ord", "path", "media_type", "algorithm", "mtime", "size", F.col("digest").alias("hash"), status.alias("status"))
    skipped = tagged.where(F.col("algorithm").isNull()).select("ord", "path", "media_type", "algorithm", "mtime", "size", F.lit(None).cast("string").alias("hash"), F.lit("skipped").alias("status"))
    every = outcomes.unionByName(skipped)
    return every, every.where("status = 'hashed'").select("ord", *FULL, "hash")


class HashCache:
    """The cache as a stored table: every change writes a new version beside the old one, which is then deleted."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark)

    def _versions(self) -> list[int]:
        """The complete versions, oldest first."""
        found = [int(n[2:]) for n in self.files.names(self.root) if re.fullmatch(r"v=\d+", n)]
        return sorted(n for n in found if self.files.exists(f"{self.root}/v={n}/_SUCCESS"))

    def read(self) -> DataFrame:
        versions = self._versions()
        schema = SCHEMAS["hash_cache"]
        return self.spark.read.schema(schema).parquet(f"{self.root}/v={versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def _replace(self, rows: DataFrame) -> None:
        versions = self._versions()
        rows.select(*FULL, "hash").write.parquet(f"{self.root}/v={(versions or [0])[-1] + 1}")
        for old in versions:
            self.files.delete(f"{self.root}/v={old}")

    def write(self, entries: DataFrame) -> None:
        """Entries (path, algorithm, mtime, size, hash, ord) over what is there."""
        self._replace(upsert(self.read(), entries))

    def prune(self, listing: DataFrame) -> int:
        """Drop the entries whose path isn't listed; how many."""
        if gone := stale(self.read(), listing).count():
            self._replace(prune(self.read(), listing))
        return gone

    def clear(self) -> int:
        """Drop all entries; how many there were."""
        if gone := self.read().count():
            self._replace(clear(self.read()))
        return gone

    def show(self) -> dict[str, int]:
        row = self.read().agg(F.count("*").alias("entries"), F.count_distinct("path").alias("paths")).first()
        return {**row.asDict(), "stored_bytes": sum(self.files.size(f"{self.root}/v={n}") for n in self._versions()[-1:])}
