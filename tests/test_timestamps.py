import pytest
from pyspark.sql import functions as F

from stratalens.operators.timestamps import CANONICAL, TimestampDictionary, normalise, parse_instants
from tests.brute_time import instant

CASES = [
    ("2021-03-28T02:30:00", "Europe/Berlin"), ("2021-10-31 02:30:00.123", "Europe/Berlin"), ("2021-03-14 02:53:58", "America/New_York"),
    ("\t2019:09:16 06:33:40", "Asia/Tokyo"), ("2019:09:16 06:33:40\0\0", None), ("1736340174", "Asia/Tokyo"), ("1564811475537", None),
    ("1726627296000000", None), ("1640002756.664", None), ("19.03.2022 21:00:30", "Europe/Berlin"), ("09/22/2023 12:20:29 AM", "America/Chicago"),
    ("09/22/2023 12:20:29 PM", "America/Chicago"), ("Tue, 22 Oct 2019 01:10:07 +0200", "UTC"), ("6 Nov 2021 12:56:59", "Asia/Kolkata"),
    ("20210107T025057Z", None), ("2025-02-19T15:45:28.141925387Z", None), ("2024-09-18", "Australia/Sydney"), ("2022-06-06 18:01", "Europe/London"),
    ("2018-08-25T13:13+02:00", None), ("2023-02-07T03:31:59[Asia/Tokyo]", "Europe/Berlin"), ("2021-01-09T08:50:38+00:00[Europe/London]", None),
    ("2024-04-26 13:24:02+02", None), ("2021-04-23 17:33:59 CEST", "Europe/Berlin"), ("2020-01-02 08:50:48 IST", "Asia/Kolkata"), ("2024-01-02 22:52:09 EST", "America/New_York"),
    ("2020-03-06 14:01:29 Z", None), ("2020-03-11t12:06:38z", None), ("2018-05-06 13:01:49,936-0500", None), ("2021-02-30T10:00:00Z", None), ("2022:13:05 11:22:33", None),
    ("2020:09:14 12:61:07", None), ("31.02.2022 09:00:00", None), ("yesterday 14:03", None), ("1899-??-??", None), ("IMG_20210704", None), ("", None), (None, None),
    ("0000:00:00 00:00:00", None), ("    :  :     :  :  ", None), ("2024-05-17T25:10:00+02:00", None), ("--", None), ("2020:06:10 14:38:26.73-04:00", "UTC"),
]


def test_against_brute_force(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, raw string, zone string")
    got = {r.i: r.utc_micros for r in parse_instants(rows, "raw", "zone").collect()}
    assert {i: got[i] for i in got} == {i: instant(*c) for i, c in enumerate(CASES)}


@pytest.mark.parametrize(("raw", "zone", "hours"), [("2020-01-02 12:00:00 IST", "Asia/Jerusalem", 10), ("2020-07-02 12:00:00 IST", "Europe/Dublin", 11), ("2020-01-02 12:00:00 CST", "Asia/Shanghai", 4)])
def test_abbreviations_follow_the_country(spark, raw, zone, hours):
    row = parse_instants(spark.createDataFrame([(raw, zone)], "raw string, zone string"), "raw", "zone").first()
    assert row.utc_micros // 3_600_000_000 % 24 == hours


def test_unknown_zone_and_long_text(spark):
    rows = spark.createDataFrame([("2020-01-01 00:00:00", "Mars/Base"), ("9" * 100_000, None), ("2020-01-01T00:00:00[No/Where]", "UTC")], "raw string, zone string")
    assert [r.utc_micros for r in parse_instants(rows, "raw", "zone").collect()] == [None] * 3


def test_dictionary_grows_by_unseen_values_only(spark, tmp_path):
    rows = lambda *raws: spark.createDataFrame([("s", r, None, 1) for r in raws], "source string, raw string, zone string, extra int")
    d = TimestampDictionary(spark, str(tmp_path / "d"))
    assert d.read().count() == 0
    d.update(rows("1736340174", "1736340174", None))
    d.update(rows("1736340174", "x"))
    assert sorted(r.raw for r in d.read().collect()) == ["1736340174", "x"]
    got = d.attach(rows("1736340174", None, "x")).collect()
    assert len(got) == 3 and {r.utc_micros for r in got} == {1736340174_000000, None}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "source string, raw string, zone string, utc string")
    assert normalise(empty).count() == 0
    clash = spark.createDataFrame([("s", "1736340174", None, "old"), ("s", "1736340174", None, "old"), (None, None, None, None)], "source string, raw string, zone string, utc_micros string")
    assert sorted(str(r.utc_micros) for r in normalise(clash).collect()) == ["1736340174000000"] * 2 + ["None"]


def test_canonical_forms():
    import re

    canonical = CANONICAL.replace(r"\z", r"\Z")
    assert re.match(canonical, "2020-01-01T00:00:00Z") and re.match(canonical, "2020-01-01T00:00:00.000000+00:00")
    assert not re.match(canonical, "2020-01-01T00:00:00z") and not re.match(canonical, "2020-01-01T00:00:00Z ")
    assert F is not None


def test_p2_found_against_brute_force(spark):
    """The whole tables of the smallest test data, read by strptime and zoneinfo."""
    import re

    import pandas as pd

    from stratalens.plans.dirty_data import p2_found

    folder = "/root/testdata/sf0.001"
    read = lambda t: pd.read_parquet(f"{folder}/{t}.parquet")
    canonical = re.compile(CANONICAL.replace(r"\z", r"\Z"))
    zones = read("report_runs").set_index("id").tz_name.to_dict()
    files = read("media_files").sort_values("loaded_at").drop_duplicates("id", keep="last")
    run_of = files.set_index("id").run_id.to_dict()
    rows = [("media_files.creation_date", str(r.id), r.creation_date, zones.get(r.run_id)) for r in files.itertuples()]
    rows += [("media_metadata.captured_at", str(r.file_id), r.captured_at, zones.get(run_of.get(r.file_id))) for r in read("media_metadata").itertuples()]
    rows += [("sessions.started_at", r.session_id, r.started_at, r.tz_name) for r in read("sessions").itertuples()]
    want = {(f, k, m) for f, k, raw, zone in rows if raw is not None and not canonical.match(raw) and (m := instant(raw, zone)) is not None}
    got = p2_found(spark, folder).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
