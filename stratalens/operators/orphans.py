"""References to records that don't exist, by compressed bitmaps.

The distinct referenced keys become integers, numbered in order of their first use so that keys used together lie
together. Per field, range of 32,768 keys and day, the references form one compressed bitmap; the parents form
others: all of them, the deleted ones, and the live ones by day of arrival. References AND-NOT parents leaves the
bits of broken references, which are decoded into keys and joined back to the rows.

A reference is ``missing`` without a parent row; else ``deleted`` if the parent's latest row is deleted; else
``late`` if the parent first arrived more than `grace_hours` after the referring row did. Null keys are no
references. A referring row or parent without an arrival time is never late.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from stratalens.operators.skew import lookup
from stratalens.work import Workspace

RANGE_BITS = 15
#: Days of rows whose arrival isn't known: such a parent was always there, such a reference comes after all parents.
ALWAYS, NEVER = -(1 << 20), 1 << 20


def pack(bits: np.ndarray) -> bytes:
    """The smaller of a sorted array of 16-bit numbers and a plain bitmap; the first byte tells which."""
    bits = np.unique(np.asarray(bits, np.uint16))
    if len(bits) * 16 < 1 << RANGE_BITS:
        return b"a" + bits.tobytes()
    plain = np.zeros(1 << RANGE_BITS, np.uint8)
    plain[bits] = 1
    return b"b" + np.packbits(plain, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The bitmap as booleans."""
    body = np.frombuffer(data, np.uint8, offset=1)
    if data[:1] == b"b":
        return np.unpackbits(body, bitorder="little").astype(bool)
    out = np.zeros(1 << RANGE_BITS, bool)
    out[body.view(np.uint16)] = True
    return out


def _pack(column: str) -> Column:
    def packed(bits: pd.Series) -> pd.Series:
        return bits.map(pack)

    return F.pandas_udf(packed, BinaryType())(column)


def _and_not(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One key range of one field: at most a few bitmaps per day."""
    found: list[tuple[int, np.ndarray, str]] = []
    there, deleted = np.zeros((2, 1 << RANGE_BITS), bool)
    for _, data in rows.loc[rows.kind == "parent", ["day", "bits"]].itertuples(index=False):
        there |= unpack(data)
    for _, data in rows.loc[rows.kind == "deleted", ["day", "bits"]].itertuples(index=False):
        deleted |= unpack(data)
    live = sorted((day, data) for day, data in rows.loc[rows.kind == "parent", ["day", "bits"]].itertuples(index=False))
    arrived, at = np.zeros(1 << RANGE_BITS, bool), 0
    for day, data in sorted(rows.loc[rows.kind == "ref", ["day", "bits"]].itertuples(index=False, name=None)):
        while at < len(live) and live[at][0] <= day:
            arrived |= unpack(live[at][1])
            at += 1
        refs = unpack(data)
        for reason, bits in (("missing", refs & ~there), ("deleted", refs & deleted), ("late", refs & there & ~deleted & ~arrived)):
            if bits.any():
                found.append((day, np.flatnonzero(bits), reason))
    field, part = key
    return pd.DataFrame(
        [(field, (int(part) << RANGE_BITS) + int(bit), int(day), reason) for day, bits, reason in found for bit in bits],
        columns=["field", "code", "day", "reason"],
    )


def _day(at: str) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int")


def references(df: DataFrame, field: str, row_id: str, key: Column, loaded_at: str, order: list[Column] | None = None) -> DataFrame:
    """(field, row_id, key, arrived, loaded_at) of the latest delivery of each referring row; `arrived` is its first."""
    window = Window.partitionBy("row_id")
    rows = df.select(F.lit(field).alias("field"), F.col(row_id).alias("row_id"), key.cast("string").alias("key"), F.col(loaded_at).alias("loaded_at"))
    rows = rows.withColumn("arrived", F.min("loaded_at").over(window)).withColumn("rn", F.row_number().over(window.orderBy(*(order or []), F.col("loaded_at").desc_nulls_last(), F.col("key").desc_nulls_last())))
    return rows.where((F.col("rn") == 1) & F.col("key").isNotNull()).drop("rn")


def parents(df: DataFrame, field: str, key: Column, loaded_at: str, deleted_at: str) -> DataFrame:
    """(field, key, arrived, deleted) per key: first arrival, and whether the latest row is deleted."""
    rows = df.select(key.cast("string").alias("key"), F.col(loaded_at).alias("at"), F.col(deleted_at).isNotNull().alias("gone"))
    rows = rows.where(F.col("key").isNotNull())
    # a null arrival ranks before all others
    last = F.max(F.struct(F.coalesce(F.unix_micros("at"), F.lit(-(1 << 62))).alias("at"), "gone"))
    return rows.groupBy("key").agg(F.min("at").alias("arrived"), last.alias("last")).select(F.lit(field).alias("field"), "key", "arrived", F.col("last.gone").alias("deleted"))


def orphans(refs: DataFrame, owners: DataFrame, grace_hours: int = 24) -> DataFrame:
    """(field, row_id, reason, loaded_at) of every broken reference; refs and owners as references() and parents() make them.

    Grace periods of at least a day are decided by bitmaps of days and then, for the late ones, by the exact times.
    """
    if grace_hours < 24:
        raise ValueError("grace_hours must be at least 24: the bitmaps tell days apart, not hours")
    spark = refs.sparkSession
    ws = Workspace(spark, "orphans")
    refs = ws.save(refs.withColumn("day", F.coalesce(_day("arrived"), F.lit(NEVER))), "refs")
    used = refs.groupBy("field", "key").agg(F.min("day").alias("day"))
    codes = used.repartitionByRange("field", "day", "key").sortWithinPartitions("field", "day", "key")
    codes = ws.save(codes.select("field", "key", F.monotonically_increasing_id().alias("code")), "codes")

    days = refs.groupBy("field", "key", "day").agg(F.lit("ref").alias("kind"))
    marked = owners.join(codes, ["field", "key"])
    marked = ws.save(marked.select("field", "key", "code", "arrived", "deleted", F.coalesce(_day("arrived"), F.lit(ALWAYS)).alias("day")), "parents")
    split = [F.shiftright("code", RANGE_BITS).alias("part"), F.col("code").bitwiseAND((1 << RANGE_BITS) - 1).cast("int").alias("bit")]
    bits = (
        days.join(codes, ["field", "key"]).select("field", "kind", "day", *split)
        .unionByName(marked.select("field", F.lit("parent").alias("kind"), "day", *split))
        .unionByName(marked.where("deleted").select("field", F.lit("deleted").alias("kind"), F.lit(0).alias("day"), *split))
    )
    # a list holds distinct bits of one range: 32,768 at most
    maps = ws.save(bits.groupBy("field", "part", "kind", "day").agg(F.collect_list("bit").alias("bits")).select("field", "part", "kind", "day", _pack("bits").alias("bits")), "bitmaps")
    survivors = maps.groupBy("field", "part").applyInPandas(_and_not, "field string, code bigint, day int, reason string")
    # the bitmaps leave keys that came on a later day than the reference; which of them are late is a matter of hours
    broken = (
        survivors.join(codes, ["field", "code"])
        .join(marked.select("field", "code", F.col("arrived").alias("parent_arrived")), ["field", "code"], "left")
        .select("field", "key", "day", "reason", "parent_arrived")
    )
    late = F.unix_micros("parent_arrived") - F.unix_micros("arrived") > grace_hours * 3_600_000_000
    # a missing parent may be the one that a third of all rows refer to
    rows = lookup(refs, ws.save(broken, "broken"), ["field", "key", "day"], refs.count())
    return rows.where((F.col("reason") != "late") | late).select("field", "row_id", "reason", "loaded_at")
