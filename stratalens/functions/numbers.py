"""Tolerant numbers of tag values as column expressions; null where a value can't be one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_negative_int(text: Column, via_float: bool = False) -> Column:
    t = F.trim(text)
    number = F.when(t.rlike(r"\A[+-]?\d+\z"), t.try_cast("bigint"))
    if via_float:
        real = t.try_cast("double")
        number = F.when(~F.isnan(real) & (F.abs(real) < 9.2e18), real.try_cast("bigint"))
    return F.when(number >= 0, number)


def non_negative_float(text: Column) -> Column:
    real = F.trim(text).try_cast("double")
    return F.when((real >= 0) & ~F.isnan(real) & (real < float("inf")), real)


def frame_rate(text: Column) -> Column:
    """numerator/denominator; no slash, a zero denominator or a rate of at most 0 give null."""
    parts = F.split(text, "/")
    over, under = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    rate = F.try_divide(over, F.nullif(under, F.lit(0.0)))
    return F.when((F.size(parts) == 2) & (rate > 0), rate)


def first_available(*values: Column) -> Column:
    """The first value that is neither null nor N/A."""
    return F.coalesce(*[F.nullif(v, F.lit("N/A")) for v in values])


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is at most 0 (or null)."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
