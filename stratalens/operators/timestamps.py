"""Mixed timestamp texts to UTC instants.

Distinct (text, zone) values go through a dictionary: each is parsed once by built-in expressions, the result is
kept in a table that later calls extend with unseen values only, and rows get their instant by an equi-join.

Rules: blanks and NUL around a text don't count; a zone in the text replaces the given one; no zone means UTC; an
ambiguous wall-clock time is the earlier instant, a skipped one moves forward by the gap; dots put the day first,
slashes the month; bare numbers are Unix time by digit count; digits beyond microseconds are cut. Impossible dates,
placeholders, nulls, unknown zones and anything unreadable give null.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators.skew import lookup
from stratalens.work import Workspace

#: Texts that are already in one of the two canonical forms.
CANONICAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|\.\d{6}\+00:00)\z"

BLANKS = "".join(map(chr, [*range(0, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"\s*([+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5})?(?:\[([A-Za-z0-9_+/-]+)\])?"
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
#: Pattern and, for the parts year|month|day|hour|minute|second|fraction|half of day|offset or abbreviation|zone, its groups.
_FORMS = (
    (rf"\A(\d{{4}})([-:/.])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt\s]\s*{_TIME}{_ZONE})?\z", "$1|$3|$4|$5|$6|$7|$8||$9|$10"),
    (rf"\A(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}\z", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"\A(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:[T\s,]\s*{_TIME}{_ZONE})?\z", "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    (rf"\A(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:[T\s,]\s*{_TIME}\s*(AM|PM)?{_ZONE})?\z", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"\A(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3}})[A-Za-z]*[\s-](\d{{4}})(?:\s+{_TIME}{_ZONE})?\z", "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
)
#: What an abbreviation means where the zone's country doesn't say otherwise, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "BST": 60,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "IST": 330, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "SAST": 120,
}


@lru_cache(1)
def known_zones() -> tuple[str, ...]:
    """Zone names that both Python and the JVM know."""
    return tuple(sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/"))) + ["UTC", "GMT"])


@lru_cache(1)
def country_abbreviations() -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, minutes): what an abbreviation means in the country of each zone, from the zone database."""
    country: dict[str, set[str]] = {}
    zones: dict[str, list[str]] = {}
    for root in zoneinfo.TZPATH:
        if (tab := Path(root, "zone.tab")).exists():
            for line in tab.read_text().splitlines():
                if line and line[0] != "#":
                    code, _, zone = line.split("\t")[:3]
                    country.setdefault(zone, set()).add(code)
                    zones.setdefault(code, []).append(zone)
            break
    meaning: dict[str, dict[str, int]] = {}
    for code, names in zones.items():
        for zone in names:
            info = zoneinfo.ZoneInfo(zone)
            for when in (dt.datetime(y, m, 15, tzinfo=dt.UTC) for y in (2024, 2021, 2018) for m in (1, 7)):
                local = when.astimezone(info)
                if (name := local.tzname() or "").isalpha():
                    meaning.setdefault(code, {}).setdefault(name, int(local.utcoffset().total_seconds()) // 60)
    return tuple(sorted({(z, a, m) for z, codes in country.items() for c in codes for a, m in meaning.get(c, {}).items() if ABBREVIATIONS.get(a) != m}))


def parse_instants(df: DataFrame, raw: str, zone: str, out: str = "utc_micros") -> DataFrame:
    """df with the instant of each text in raw as microseconds since 1970, wall-clock texts read in zone.

    Built-in expressions only; unreadable texts give null. Works on any rows; normalise() is the way for large tables.
    A column of df that is named like the result is replaced.
    """
    spark = df.sparkSession
    df = df.drop(out) if out not in (raw, zone) else df
    clean = F.btrim(F.col(raw), F.lit(BLANKS))
    form = F.lit(None).cast("string")
    for pattern, groups in reversed(_FORMS):
        form = F.when(F.col("__s").rlike(pattern), F.regexp_replace("__s", pattern, groups)).otherwise(form)
    number = F.col("__s").rlike(r"\A\d{9,20}(?:\.\d+)?\z")
    df = df.withColumn("__s", clean).withColumn("__p", F.split(form, r"\|")).withColumn("__num", F.when(number, F.col("__s")))
    part = lambda i: F.nullif(F.get("__p", F.lit(i)), F.lit(""))
    whole = lambda i: part(i).try_cast("int")
    month = F.coalesce(whole(1), F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.initcap(F.substring(part(1), 1, 3))), F.lit(0)).cast("int"))
    half = F.upper(part(7))
    hour = F.coalesce(whole(3), F.lit(0))
    hour = F.when(half.isNull(), hour).when((hour < 1) | (hour > 12), F.lit(None)).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    fraction = F.rpad(F.coalesce(F.substring(part(6), 1, 6), F.lit("")), 6, "0").try_cast("int")
    text_zone, mark = part(9), F.upper(part(8))
    minutes = F.regexp_extract(part(8), r"\A[+-](\d{2}):?(\d{2})?\z", 2)
    offset = F.when(mark.rlike(r"\A[+-]"), F.when(F.substring(mark, 1, 1) == "-", -1).otherwise(1) * (F.substring(mark, 2, 2).try_cast("int") * 60 + F.coalesce(F.nullif(minutes, F.lit("")).try_cast("int"), F.lit(0))))
    df = df.select(
        "*",
        F.try_make_timestamp(whole(0), month, whole(2), hour, F.coalesce(whole(4), F.lit(0)), F.coalesce(whole(5), F.lit(0)).cast("decimal(8,6)"), F.lit("UTC")).alias("__wall"),
        fraction.alias("__frac"), mark.alias("__mark"), offset.alias("__off"), (F.coalesce(whole(5), F.lit(0)) > 59).alias("__leap"),
        F.coalesce(text_zone, F.col(zone), F.lit("UTC")).alias("__zone"), text_zone.alias("__tz"),
    )
    # the table is computed from the zone database: some hundred rows, whatever the data
    abbreviations = spark.createDataFrame(list(country_abbreviations()), "__z string, __a string, __min int")
    df = df.join(F.broadcast(abbreviations), (F.col("__a") == F.col("__mark")) & (F.col("__z") == F.coalesce(F.col("__tz"), F.col(zone))), "left")
    default = F.expr("CASE __mark " + " ".join(f"WHEN '{a}' THEN {m}" for a, m in ABBREVIATIONS.items()) + " END")
    off = F.coalesce(F.col("__off"), F.when(F.col("__mark").isNotNull(), F.coalesce(F.col("__min"), default)))
    wall = F.unix_micros("__wall") + F.col("__frac")
    valid_zone = F.expr("__zone IN ('" + "','".join(known_zones()) + "')")
    zoned = F.when(valid_zone, F.unix_micros(F.to_utc_timestamp("__wall", F.when(valid_zone, F.col("__zone")).otherwise("UTC"))) + F.col("__frac"))
    # bare numbers: the decimal point is moved within the text, so that no digit is lost to floating point
    digits = F.substring_index("__num", ".", 1)
    decimals = F.rpad(F.regexp_extract("__num", r"\.(\d+)\z", 1), 6, "0")
    unix = (
        F.when(F.length(digits) <= 11, F.concat(digits, decimals).try_cast("bigint"))
        .when(F.length(digits) <= 14, F.concat(digits, F.substring(decimals, 1, 3)).try_cast("bigint"))
        .when(F.length(digits) <= 17, digits.try_cast("bigint"))
        .otherwise(F.floor(digits.try_cast("decimal(20,0)") / 1000).try_cast("bigint"))
    )
    instant = (
        F.when(F.col("__num").isNotNull(), unix)
        .when(F.col("__wall").isNull() | F.col("__leap") | (F.abs(F.coalesce(F.col("__off"), F.lit(0))) > 18 * 60), F.lit(None))
        .when(F.col("__mark").isNotNull() & F.col("__tz").isNull() | F.col("__off").isNotNull(), wall - off.cast("bigint") * 60_000_000)
        .otherwise(zoned)
    )
    helpers = ("__s", "__p", "__num", "__wall", "__frac", "__mark", "__off", "__leap", "__zone", "__tz", "__z", "__a", "__min")
    return df.withColumn("__instant", instant).drop(*helpers).withColumnRenamed("__instant", out)


class TimestampDictionary:
    """A growing table of (source, text, zone, instant); update() parses and appends only what it hasn't seen. One writer at a time."""

    SCHEMA = "source string, raw string, zone string, utc_micros bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def update(self, values: DataFrame) -> None:
        """Add the distinct (source, raw, zone) of values; null texts are left out, null zones count as UTC."""
        new = values.where(F.col("raw").isNotNull()).select("source", "raw", F.coalesce("zone", F.lit("UTC")).alias("zone")).distinct()
        if self._exists():
            new = new.join(self.read().select("source", "raw", "zone"), ["source", "raw", "zone"], "left_anti")
        parse_instants(new, "raw", "zone").select("source", "raw", "zone", "utc_micros").write.mode("append").parquet(self.path)

    def attach(self, rows: DataFrame) -> DataFrame:
        """rows (with source, raw, zone), which should be stored, and their instant; texts without one keep null.

        A placeholder or default time may be the text of a third of all rows, so hot texts are looked up apart.
        """
        keyed = rows.drop("utc_micros").withColumn("zone", F.coalesce("zone", F.lit("UTC")))
        return lookup(keyed, self.read(), ["source", "raw", "zone"], rows.count(), "left")


def normalise(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (source, raw, zone, ...) with utc_micros, by way of the dictionary at path (a fresh one if None).

    Other columns pass through; one named utc_micros is replaced. Repeated rows stay repeated.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "timestamps")
    rows = ws.save(rows, "rows")
    dictionary = TimestampDictionary(spark, path or f"{ws.root}/dictionary")
    dictionary.update(rows)
    return dictionary.attach(rows)
