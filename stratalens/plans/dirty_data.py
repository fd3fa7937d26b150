"""Queries on the media library's own dirt: timestamps of many writers (p2) and broken references (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import orphans as o
from stratalens.operators.latest import latest_rows
from stratalens.operators.timestamps import CANONICAL, normalise
from stratalens.tables import table
from stratalens.work import work_dir


def timestamp_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(field, record_key, raw, zone) of every timestamp text that isn't canonical yet."""
    newest = [F.col("loaded_at").desc_nulls_last()]
    odd = lambda c: F.when(~F.col(c).rlike(CANONICAL), F.col(c))
    zones = table(spark, folder, "report_runs", "id", "tz_name").select(F.col("id").alias("run_id"), F.col("tz_name").alias("zone"))
    files = table(spark, folder, "media_files", "id", "run_id", "creation_date", "loaded_at").withColumn("raw", odd("creation_date")).drop("creation_date")
    files = latest_rows(files, ["id"], newest)
    metadata = table(spark, folder, "media_metadata", "file_id", "captured_at").withColumn("raw", odd("captured_at")).where(F.col("raw").isNotNull())
    metadata = metadata.repartition("file_id").select("file_id", "raw").distinct()
    captured = metadata.join(files.select(F.col("id").alias("file_id"), "run_id"), "file_id", "left")
    sessions = table(spark, folder, "sessions", "session_id", "started_at", "tz_name", "loaded_at")
    sessions = latest_rows(sessions.withColumn("k", F.lower(F.trim("session_id"))), ["k"], newest)
    both = (
        files.where(F.col("raw").isNotNull()).select(F.lit("media_files.creation_date").alias("field"), F.col("id").cast("string").alias("record_key"), "raw", "run_id")
        .unionByName(captured.select(F.lit("media_metadata.captured_at").alias("field"), F.col("file_id").cast("string").alias("record_key"), "raw", "run_id"))
    )
    started = sessions.select(F.lit("sessions.started_at").alias("field"), F.col("session_id").alias("record_key"), odd("started_at").alias("raw"), F.col("tz_name").alias("zone"))
    return both.join(zones, "run_id", "left").select("field", "record_key", "raw", "zone").unionByName(started.where(F.col("raw").isNotNull()))


def dictionary_path(spark: SparkSession) -> str:
    """The dictionary of all texts ever parsed, in the work folder; an instant depends on text and zone alone, so all runs share it."""
    return f"{work_dir(spark)}/timestamp-dictionary"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every timestamp text that names an instant and isn't canonical, with that instant."""
    rows = timestamp_rows(spark, folder).withColumnRenamed("field", "source")
    return normalise(rows, dictionary_path(spark)).where(F.col("utc_micros").isNotNull()).select(F.col("source").alias("field"), "record_key", "utc_micros").distinct()


def p2_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows per field are not canonical, readable or not."""
    rows = timestamp_rows(spark, folder).withColumnRenamed("field", "source")
    return normalise(rows, dictionary_path(spark)).groupBy(F.col("source").alias("field"), F.col("utc_micros").isNotNull().alias("readable")).agg(F.count("*").alias("n_rows"))


def broken_references(spark: SparkSession, folder: str) -> DataFrame:
    """(field, row_id, reason, loaded_at) over the three reference fields of the library."""
    pair = lambda a, b: F.when(F.col(b).isNotNull(), F.concat_ws(":", F.coalesce(F.col(a).cast("string"), F.lit("")), F.col(b).cast("string")))
    name = F.lower(F.trim(F.regexp_replace("session_id", r"(?U)^\s+|\s+$", "")))
    files = table(spark, folder, "media_files", "id", "run_id", "group_id", "loaded_at", "deleted_at")
    groups = table(spark, folder, "duplicate_groups", "id", "run_id", "best_file_id", "loaded_at", "deleted_at")
    refs = (
        o.references(groups, "duplicate_groups.best_file_id", "id", pair("run_id", "best_file_id"), "loaded_at")
        .unionByName(o.references(files, "media_files.group_id", "id", pair("run_id", "group_id"), "loaded_at"))
        .unionByName(o.references(table(spark, folder, "commands", "seq", "session_id", "loaded_at"), "commands.session_id", "seq", F.nullif(name, F.lit("")), "loaded_at"))
    )
    owners = (
        o.parents(files, "duplicate_groups.best_file_id", pair("run_id", "id"), "loaded_at", "deleted_at")
        .unionByName(o.parents(groups, "media_files.group_id", pair("run_id", "id"), "loaded_at", "deleted_at"))
        .unionByName(o.parents(table(spark, folder, "sessions", "session_id", "loaded_at", "deleted_at"), "commands.session_id", name, "loaded_at", "deleted_at"))
    )
    return o.orphans(refs, owners)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every broken reference with its reason."""
    return broken_references(spark, folder).select(F.col("field").alias("ref_field"), "row_id", "reason")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Broken references per field, month of loaded_at and reason."""
    rows = broken_references(spark, folder)
    return rows.groupBy(F.col("field").alias("ref_field"), F.date_format("loaded_at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n"))


#: Reads texts (raw, tz) of a CTE src into micros, for the forms that the test data hold. DuckDB takes the later of two
#: repeated times, so the earlier one is tried first.
PARSE_SQL = r"""
  s AS (SELECT *, trim(raw, E' \t\r\n' || chr(0)) AS s FROM src),
  f AS (
    SELECT *, CASE
      WHEN regexp_full_match(s, '\d{4}[-:]\d\d[-:]\d\d([Tt ]\d\d:\d\d(:\d\d([.,]\d+)?)? ?([Zz]|[+-]\d\d(:?\d\d)?|[A-Z]{2,5})?(\[[A-Za-z_/]+\])?)?')
        THEN regexp_replace(s, '^(\d{4})[-:](\d\d)[-:](\d\d)(?:[Tt ](\d\d):(\d\d)(?::(\d\d)(?:[.,](\d+))?)? ?([Zz]|[+-]\d\d(?::?\d\d)?|[A-Z]{2,5})?(?:\[([A-Za-z_/]+)\])?)?$', '\1|\2|\3|\4|\5|\6|\7||\8|\9')
      WHEN regexp_full_match(s, '\d{8}T\d{6}Z') THEN regexp_replace(s, '^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)Z$', '\1|\2|\3|\4|\5|\6|||Z|')
      WHEN regexp_full_match(s, '\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d') THEN regexp_replace(s, '^(\d\d)\.(\d\d)\.(\d{4}) (\d\d):(\d\d):(\d\d)$', '\3|\2|\1|\4|\5|\6||||')
      WHEN regexp_full_match(s, '\d\d/\d\d/\d{4} \d\d:\d\d:\d\d [AP]M') THEN regexp_replace(s, '^(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d):(\d\d) ([AP]M)$', '\3|\1|\2|\4|\5|\6||\7||')
      WHEN regexp_full_match(s, '([A-Z][a-z]{2}, )?\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d( [+-]\d{4})?') THEN regexp_replace(s, '^(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d\d):(\d\d):(\d\d)(?: ([+-]\d{4}))?$', '\3|\2|\1|\4|\5|\6|||\7|')
    END AS n FROM s
  ),
  p AS (SELECT *, list_transform(string_split(n, '|'), lambda x: nullif(x, '')) AS p FROM f),
  w AS (
    SELECT *, coalesce(try_cast(p[2] AS INT), nullif(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], p[2]), 0)) AS mo,
      CASE WHEN p[8] IS NULL THEN coalesce(p[4], '0')::INT ELSE p[4]::INT % 12 + CASE p[8] WHEN 'PM' THEN 12 ELSE 0 END END AS h,
      rpad(left(coalesce(p[7], ''), 6), 6, '0')::BIGINT AS frac, upper(p[9]) AS mark, coalesce(p[10], tz, 'UTC') AS zone
    FROM p
  ),
  t AS (
    SELECT *, try_cast(printf('%s-%02d-%s %02d:%s:%s', p[1], mo, lpad(p[3], 2, '0'), h, coalesce(p[5], '00'), coalesce(p[6], '00')) AS TIMESTAMP) AS wall,
      CASE WHEN left(mark, 1) IN ('+', '-') THEN (CASE left(mark, 1) WHEN '-' THEN -1 ELSE 1 END) * (mark[2:3]::INT * 60 + coalesce(try_cast(nullif(right(replace(mark, ':', ''), 2), '') AS INT) * (length(mark) > 3)::INT, 0))
        ELSE CASE mark WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'BST' THEN 60 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CST' THEN -360 WHEN 'CDT' THEN -300 WHEN 'JST' THEN 540 WHEN 'IST' THEN 330 WHEN 'AEST' THEN 600 WHEN 'AEDT' THEN 660 END END AS off
    FROM w
  ),
  z AS (SELECT *, CASE WHEN mark IS NULL AND wall IS NOT NULL THEN timezone(zone, wall) END AS late FROM t),
  m AS (
    SELECT *, CASE
      WHEN regexp_full_match(s, '\d{9,11}(\.\d+)?') THEN (split_part(s, '.', 1) || rpad(left(split_part(s, '.', 2), 6), 6, '0'))::BIGINT
      WHEN regexp_full_match(s, '\d{12,14}') THEN s::BIGINT * 1000
      WHEN regexp_full_match(s, '\d{15,17}') THEN s::BIGINT
      WHEN mark IS NOT NULL THEN epoch_us(wall) + frac - off::BIGINT * 60000000
      WHEN timezone(zone, late - INTERVAL 1 HOUR) = wall THEN epoch_us(late) - 3600000000 + frac
      ELSE epoch_us(late) + frac END AS micros
    FROM z
  )
"""
_TEXTS = """
  WITH files AS (SELECT * FROM media_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
  every AS (
    SELECT 'media_files.creation_date' AS field, f.id::VARCHAR AS record_key, creation_date AS raw, tz_name AS tz FROM files f LEFT JOIN report_runs r ON r.id = f.run_id
    UNION SELECT 'media_metadata.captured_at', file_id::VARCHAR, captured_at, tz_name FROM media_metadata LEFT JOIN files f ON f.id = file_id LEFT JOIN report_runs r ON r.id = f.run_id
    UNION SELECT 'sessions.started_at', session_id, started_at, tz_name FROM sessions
  ),
  src AS (SELECT * FROM every WHERE NOT regexp_full_match(raw, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(Z|\\.\\d{6}\\+00:00)')),
"""

_BROKEN = """
  WITH files AS (SELECT * FROM media_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
  groups AS (SELECT * FROM duplicate_groups QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
  cmds AS (SELECT * FROM commands QUALIFY row_number() OVER (PARTITION BY seq ORDER BY loaded_at DESC) = 1),
  refs AS (
    SELECT 'media_files.group_id' ref_field, id row_id, run_id || ':' || group_id k, loaded_at, (SELECT min(loaded_at) FROM media_files x WHERE x.id = files.id) arrived FROM files WHERE group_id IS NOT NULL
    UNION ALL SELECT 'duplicate_groups.best_file_id', id, run_id || ':' || best_file_id, loaded_at, (SELECT min(loaded_at) FROM duplicate_groups x WHERE x.id = groups.id) FROM groups WHERE best_file_id IS NOT NULL
    UNION ALL SELECT 'commands.session_id', seq, lower(trim(session_id, E' \\t\\r\\n')), loaded_at, (SELECT min(loaded_at) FROM commands x WHERE x.seq = cmds.seq) FROM cmds WHERE trim(session_id, E' \\t\\r\\n') <> ''
  ),
  own AS (
    SELECT 'media_files.group_id' ref_field, run_id || ':' || id k, min(loaded_at) arrived, arg_max(deleted_at IS NOT NULL, loaded_at) gone FROM duplicate_groups GROUP BY 1, 2
    UNION ALL SELECT 'duplicate_groups.best_file_id', run_id || ':' || id, min(loaded_at), arg_max(deleted_at IS NOT NULL, loaded_at) FROM media_files GROUP BY 1, 2
    UNION ALL SELECT 'commands.session_id', lower(trim(session_id, E' \\t\\r\\n')), min(loaded_at), arg_max(deleted_at IS NOT NULL, loaded_at) FROM sessions GROUP BY 1, 2
  ),
  found AS (
    SELECT r.ref_field, r.row_id, r.loaded_at, CASE WHEN o.k IS NULL THEN 'missing' WHEN o.gone THEN 'deleted' WHEN o.arrived > r.arrived + INTERVAL 24 HOUR THEN 'late' END reason
    FROM refs r LEFT JOIN own o ON o.ref_field = r.ref_field AND o.k = r.k
  )
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_unreadable": p2_unreadable, "p3_found": p3_found, "p3_counts": p3_counts}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _TEXTS + PARSE_SQL + "SELECT DISTINCT field, record_key, micros AS utc_micros FROM m WHERE micros IS NOT NULL",
        "p2_unreadable": _TEXTS + PARSE_SQL + "SELECT field, micros IS NOT NULL AS readable, count(*) AS n_rows FROM m GROUP BY ALL",
        "p3_found": _BROKEN + "SELECT ref_field, row_id, reason FROM found WHERE reason IS NOT NULL",
        "p3_counts": _BROKEN + "SELECT ref_field, strftime(loaded_at::TIMESTAMP, '%Y-%m') AS month, reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    }
