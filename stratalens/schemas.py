"""Declared schemas of the library's tables, and the domains and keys they promise (Spark enforces none of them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_VERSION = 1
METADATA = "width bigint, height bigint, duration_seconds double, codec string, bitrate bigint, frame_rate double, sample_rate bigint, channels bigint, image_format string, color_mode string, bit_depth bigint, has_alpha boolean, captured_at timestamp"
SCHEMAS: dict[str, str] = {
    "schema_version": "version int, applied_at string",
    "report_runs": "id bigint, root_path string, status string, started_at string, completed_at string, total_files bigint, duplicate_count bigint, notes string",
    "duplicate_groups": "id bigint, run_id bigint, group_number bigint, media_type string, file_count bigint, best_file_id bigint, target_path string",
    "media_files": "id bigint, run_id bigint, group_id bigint, path string, filename string, media_type string, size_bytes bigint, content_hash string, creation_date string, quality_score double, metadata string",
    "operations": "id bigint, run_id bigint, media_file_id bigint, operation string, status string, source string, destination string, created_at string",
    "hash_cache": "path string, algorithm string, mtime double, size bigint, hash string",
    "sessions": "session_id string, started_at string, completed_at string, status string, config_digest string, source string, destination string",
    "commands": "seq bigint, session_id string, command_type string, args_json string, log_json string, status string, started_at string, completed_at string",
}
#: Allowed values (fixed values of the data model).
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("report_runs", "status"): ("running", "completed", "failed"),
    ("operations", "operation"): ("backup", "copy", "delete", "mkdir", "move", "restore"),
    ("operations", "status"): ("applied", "rolled_back"),
    ("sessions", "status"): ("running", "completed", "failed", "rolled_back", "interrupted"),
    ("commands", "status"): ("in_progress", "done", "undone", "failed", "interrupted"),
    ("media_files", "media_type"): ("image", "video", "audio"),
}
HASH_ALGORITHMS = ("md5", "sha256", "ahash", "phash", "dhash", "whash")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def json_schema(name: str) -> str:
    """The table's schema as JSON, for export."""
    return schema(name).json()


def domain_check(table: str, column: str) -> Column:
    """True where a value is allowed; null counts as not allowed."""
    return F.coalesce(F.col(column).isin(*DOMAINS[table, column]), F.lit(False))


def domain_violations(df: DataFrame, table: str) -> DataFrame:
    """(column, value, n) of values outside their domain."""
    parts = [df.where(~domain_check(table, c)).groupBy(F.lit(c).alias("column"), F.col(c).alias("value")).agg(F.count("*").alias("n")) for t, c in DOMAINS if t == table]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_parents(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose non-null foreign key has no parent row."""
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return child.where(present).join(parent.select(*keys), keys, "left_anti")
