"""Metadata of videos and sounds from the JSON that a probing program prints."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.dates import iso_datetime
from stratalens.functions.numbers import first_available, frame_rate, non_negative_float, non_negative_int

STREAM = "codec_type string, codec_name string, width string, height string, duration string, bit_rate string, r_frame_rate string, avg_frame_rate string, sample_rate string, channels string, tags map<string,string>"
PROBE = f"streams array<struct<{', '.join(f.replace(' ', ':', 1) for f in STREAM.split(', '))}>>, format struct<duration:string,bit_rate:string,tags:map<string,string>>"
CODECS = {"mp3": "MP3", "aac": "AAC", "flac": "FLAC", "vorbis": "Vorbis", "opus": "Opus", "alac": "ALAC", "pcm_s16le": "PCM"}
ALIASES = {"date": "year", "tracknumber": "track"}


def parsed(payload: Column) -> Column:
    return F.from_json(payload, PROBE)


def video_metadata(payload: Column) -> Column:
    """The metadata struct of a probed video; values missing in the stream come from the container; null for no JSON."""
    p = parsed(payload)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a, box = first("video"), first("audio"), p["format"]
    return F.when(
        p.isNotNull(),
        F.struct(
            non_negative_int(v["width"]).alias("width"), non_negative_int(v["height"]).alias("height"),
            non_negative_float(first_available(v["duration"], box["duration"])).alias("duration_seconds"), v["codec_name"].alias("codec"),
            non_negative_int(first_available(v["bit_rate"], box["bit_rate"]), via_float=True).alias("bitrate"), frame_rate(first_available(v["avg_frame_rate"], v["r_frame_rate"])).alias("frame_rate"),
            non_negative_int(a["sample_rate"]).alias("sample_rate"), non_negative_int(a["channels"]).alias("channels"),
            iso_datetime(first_available(v["tags"]["creation_time"], box["tags"]["creation_time"]))["at"].alias("captured_at"),
        ),
    )


def audio_metadata(payload: Column) -> Column:
    p = parsed(payload)
    a = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in CODECS.items() for x in kv])[a["codec_name"]], a["codec_name"])
    return F.when(p.isNotNull(), F.struct(non_negative_float(first_available(a["duration"], p["format"]["duration"])).alias("duration_seconds"), label.alias("codec"), non_negative_int(first_available(a["bit_rate"], p["format"]["bit_rate"]), True).alias("bitrate"), non_negative_int(a["sample_rate"]).alias("sample_rate"), non_negative_int(a["channels"]).alias("channels")))


def container_tags(payload: Column) -> Column:
    """The container's tags with lower-case keys, empty for anything unreadable."""
    tags = F.transform_keys(parsed(payload)["format"]["tags"], lambda k, _: F.lower(k))
    return F.coalesce(tags, F.create_map().cast("map<string,string>"))


def audio_tags(tags: Column) -> Column:
    """Lower-case keys, date as year and tracknumber as track, list values joined."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.transform_values(F.transform_keys(tags, lambda k, _: F.coalesce(names[F.lower(k)], F.lower(k))), lambda _, v: F.array_join(v, ", "))


def probe(files: DataFrame, path: str = "path", program: str = "ffprobe", seconds: int = 30) -> DataFrame:
    """files plus payload and error from running the program per file on the executors; without it both stay null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shutil.which(program)
        for batch in batches:
            rows = []
            for name in batch[path]:
                if not found:
                    rows.append((name, None, None))
                    continue
                try:
                    run = subprocess.run([found, "-v", "error", "-print_format", "json", "-show_format", "-show_streams", "--", name], capture_output=True, timeout=seconds)
                    rows.append((name, run.stdout.decode("utf-8", "replace"), None) if not run.returncode else (name, None, run.stderr.decode("utf-8", "replace")))
                except (OSError, subprocess.TimeoutExpired) as error:
                    rows.append((name, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "payload", "error"])

    return files.select(path).mapInPandas(work, "path string, payload string, error string")
