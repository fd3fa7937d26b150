"""Files as tables: Spark's binary and image sources, and an exact driver-side walk for what listings don't show."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import media_bytes
from stratalens.functions.text import basename, format_of, media_type, normalize_extension, sniff
from stratalens.schemas import METADATA
from stratalens.sources import probes

LISTING = "rel string, is_dir boolean, is_symlink boolean, size bigint, mtime double, resolved string"
#: Cells hold whole files, so the content of larger ones isn't read: null, with an issue.
MAX_CONTENT = 1 << 30


def regular_files(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, size, mtime, media_type[, content, issue]) by a distributed listing; content is read only if asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = F.regexp_replace("path", r"\Afile:/*", "/")
    if content:
        # two scans, since one that selects the content reads every file that its length condition doesn't skip
        whole = df.where(F.col("length") <= MAX_CONTENT).withColumn("issue", F.lit(None).cast("string"))
        large = df.drop("content").where(F.col("length") > MAX_CONTENT).withColumn("content", F.lit(None).cast("binary"))
        df = whole.unionByName(large.withColumn("issue", F.lit(f"content not read: larger than {MAX_CONTENT} bytes")))
    kind = media_type(normalize_extension(basename(path)), sniff(F.col("content")) if content else None)
    return df.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), kind.alias("media_type"), *(["content", "issue"] if content else []))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Every entry below root with its link target; special files (FIFOs, sockets) are left out. Runs on the driver."""
    rows = []
    for folder, dirs, names in os.walk(root):
        for name in [*dirs, *names]:
            path = os.path.join(folder, name)
            try:
                info, link = os.stat(path), os.path.islink(path)
            except OSError:
                continue
            if stat.S_ISREG(info.st_mode) or stat.S_ISDIR(info.st_mode):
                rows.append((os.path.relpath(path, root), stat.S_ISDIR(info.st_mode), link, info.st_size, info.st_mtime, os.path.realpath(path)))
    listing = spark.createDataFrame(rows, LISTING)
    return listing.withColumn("media_type", F.when(~F.col("is_dir"), media_type(normalize_extension(basename(F.col("rel"))))))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures: image.origin, height, width, nChannels, mode, data; undecodable files have height -1."""
    return spark.read.format("image").load(path)


def with_image_metadata(files: DataFrame) -> DataFrame:
    """files (with content) plus header, exif, chunks, xmp and the capture time of the first tag that parses."""
    from stratalens.functions.dates import capture_time

    df = files.withColumn("header", media_bytes.image_header(F.col("content"))).withColumn("exif", media_bytes.exif_tags(F.col("content")))
    df = df.withColumn("chunks", media_bytes.png_text(F.col("content"))).withColumn("xmp", media_bytes.xmp_packet(F.col("content"))).withColumn("c2pa", media_bytes.c2pa_manifest(F.col("content")))
    return df.withColumn("captured_at", capture_time(F.col("exif")["DateTimeOriginal"], F.col("exif")["DateTime"]))


def extract(files: DataFrame) -> DataFrame:
    """(path, media_type, metadata, error) of files (path, size, media_type, content, and payload if a probe ran).

    Dispatch by media type: pictures by their bytes, or, where no header can be read, by the size and time in their EXIF
    tags and their suffix; videos and sounds by the probe's output. What gives nothing has an error, and metadata null.
    """
    payload = F.col("payload") if "payload" in files.columns else F.lit(None).cast("string")
    df = with_image_metadata(files.withColumn("content", F.when((F.col("media_type") == "image") & (F.col("size") > 0), F.col("content"))))
    number = lambda *names: F.coalesce(*[F.col("exif")[n].try_cast("bigint") for n in names])
    width, height = F.coalesce("header.width", number("ExifImageWidth", "ImageWidth")), F.coalesce("header.height", number("ExifImageHeight", "ImageLength"))
    none = lambda kind: F.lit(None).cast(kind)
    fields = [f.rsplit(" ", 1) for f in METADATA.split(", ")]
    shaped = lambda values: F.struct(*[values.get(n, none(k)).cast(k).alias(n) for n, k in fields])
    image = shaped({
        "width": width, "height": height, "image_format": F.coalesce("header.image_format", format_of(F.col("path"))), "color_mode": F.col("header.color_mode"),
        "bit_depth": F.col("header.bit_depth"), "has_alpha": F.col("header.has_alpha"), "captured_at": F.col("captured_at"),
    })
    video, audio = probes.video_metadata(payload), probes.audio_metadata(payload)
    taken = lambda source, *names: shaped({n: source[n] for n in names})
    moving = taken(video, "width", "height", "duration_seconds", "codec", "bitrate", "frame_rate", "sample_rate", "channels", "captured_at")
    sound = taken(audio, "duration_seconds", "codec", "bitrate", "sample_rate", "channels")
    error = (
        F.when(F.coalesce(F.col("size"), F.lit(0)) <= 0, "empty file")
        .when(F.col("media_type").isNull(), "unsupported media type")
        .when((F.col("media_type") == "image") & width.isNull() & height.isNull(), "unsupported or corrupt image")
        .when((F.col("media_type") != "image") & video.isNull(), "no probe output")
    )
    metadata = F.when(F.col("media_type") == "image", image).when(F.col("media_type") == "video", moving).when(F.col("media_type") == "audio", sound)
    return df.withColumn("error", error).select("path", "media_type", F.when(F.col("error").isNull(), metadata).alias("metadata"), "error")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """One row about one file."""
    return with_image_metadata(regular_files(spark, path, content=True)).drop("content")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)
