"""Quality of the copies in a group: metrics, normalised by the group's maxima, weighted and ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.errors import DuplicateError
from stratalens.functions.numbers import ratio


@dataclass(frozen=True)
class Weights:
    """Relative weights; at least one above zero, none below."""

    resolution: float = 1.0
    file_size: float = 1.0
    sharpness: float = 1.0
    bitrate: float = 1.0

    def __post_init__(self) -> None:
        values = (self.resolution, self.file_size, self.sharpness, self.bitrate)
        if min(values) < 0 or sum(values) <= 0:
            raise DuplicateError("weights must not be negative and not all zero", details={"weights": values})


METRICS = ("resolution", "file_size", "sharpness", "bitrate")


def metrics(width: Column, height: Column, size: Column, bitrate: Column, media_type: Column, sharpness: Column | None = None) -> list[Column]:
    """The raw metrics, 0 where unknown; sharpness counts for images only."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    sharp = F.lit(0.0) if sharpness is None else F.when(media_type == "image", F.coalesce(sharpness, F.lit(0.0))).otherwise(0.0)
    return [(zero(width) * zero(height)).cast("bigint").alias("resolution"), zero(size).cast("bigint").alias("file_size"), sharp.alias("sharpness"), zero(bitrate).cast("bigint").alias("bitrate")]


def ranked(files: DataFrame, group: list[str], path: str, weights: Weights | None = None) -> DataFrame:
    """files (with the four metrics) plus composite and rank; ties go to resolution, size, then the smallest path.

    The maxima are one aggregate per group joined back, which combines before its shuffle.
    """
    w = weights or Weights()
    maxima = files.groupBy(*group).agg(*[F.max(m).alias(f"max_{m}") for m in METRICS])
    scored = files.join(maxima, group)
    parts = [getattr(w, m) * ratio(F.col(m), F.col(f"max_{m}")) for m in METRICS]
    total = w.resolution + w.file_size + w.sharpness + w.bitrate
    scored = scored.withColumn("composite", (parts[0] + parts[1] + parts[2] + parts[3]) / total).drop(*[f"max_{m}" for m in METRICS])
    order = Window.partitionBy(*group).orderBy(F.col("composite").desc(), F.col("resolution").desc(), F.col("file_size").desc(), F.col(path))
    return scored.withColumn("rank", F.row_number().over(order))


def best(ranked_files: DataFrame) -> DataFrame:
    return ranked_files.where("rank = 1")


def require_members(members: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """members joined with files; raises if a member is unknown."""
    if lost := members.join(files, keys, "left_anti").first():
        raise DuplicateError("a group member is not among the files", details={k: lost[k] for k in keys})
    return members.join(files, keys)
