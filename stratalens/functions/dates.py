"""Dates of camera tags, containers and reports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Writers' formats: reports to the second, defaults to the millisecond, the operation log to the microsecond.
REPORT, DEFAULT, LOG = "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def exif_datetime(text: Column) -> Column:
    """Naive time of a YYYY:MM:DD HH:MM:SS tag, fields of one or two digits; anything else null."""
    t = F.btrim(text, F.lit(" \t\r\n\0"))
    parts = r"\A(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})\z"
    got = F.split(F.regexp_replace(t, parts, "$1|$2|$3|$4|$5|$6"), r"\|")
    number = lambda i: F.get(got, F.lit(i)).try_cast("int")
    second = number(5)
    return F.when(t.rlike(parts) & (second < 60), F.to_timestamp_ntz(F.try_make_timestamp(number(0), number(1), number(2), number(3), number(4), second.cast("decimal(8,6)"), F.lit("UTC")).cast("string")))


def iso_datetime(text: Column) -> Column:
    """struct(at, has_offset) of an ISO time; a time without offset is read as UTC and flagged as naive."""
    t = F.regexp_replace(F.trim(text), r"[zZ]\z", "+00:00")
    return F.struct(F.when(t.rlike(r"\A\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp")).alias("at"), t.rlike(r"[T ]\d{2}:.*[+-]\d{2}:?\d{2}\z").alias("has_offset"))


def capture_time(*tags: Column) -> Column:
    """The first tag that parses."""
    return F.coalesce(*map(exif_datetime, tags))


def report_time(at: Column) -> Column:
    return F.date_format(at, REPORT)


def default_time(at: Column) -> Column:
    return F.date_format(at, DEFAULT)


def log_time(at: Column) -> Column:
    return F.concat(F.date_format(at, LOG), F.lit("+00:00"))


def session_id(at: Column, token: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(token, 1, 8))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two instants; null if the end lies before the start."""
    return F.when(end >= start, (F.unix_micros(end) - F.unix_micros(start)) / 1e6)
