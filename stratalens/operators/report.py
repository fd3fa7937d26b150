"""The report store: versioned tables per run, published by one small manifest file per version.

A run's tables are parquet folders under <root>/<table>/run_id=R/attempt=A; readers follow the manifest of the highest
version, so a run appears or changes as a whole or not at all. A writer publishes the version after the one it read;
if another was faster, it fails with an error and nothing changes, so writers need no lock. Single rows are appended as
further folders of their table. All files lie on the session's (shared) file system. Ids have no meaning but identity.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.errors import ReportError
from stratalens.functions.dates import default_time, report_time
from stratalens.functions.text import basename
from stratalens.schemas import DOMAINS, SCHEMAS, schema
from stratalens.work import SharedFiles, Workspace

TERMINAL = ("completed", "failed")
TABLES = ("report_runs", "media_files", "duplicate_groups", "operations")


@dataclass
class RunExport:
    """files: path, media_type, size_bytes, creation_date (timestamp?), metadata (struct?), content_hash?, quality_score?;
    groups: group_number, media_type, path (one row per member), target_path?; operations: operation, status, source?, destination?."""

    root_path: str
    files: DataFrame
    groups: DataFrame
    operations: DataFrame
    status: str = "completed"
    notes: str | None = None


def violations(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(problem, path, n): repeated paths, members that are no files, members of several groups or twice in one."""
    twice = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate path").alias("problem"), "path", "n")
    unknown = groups.join(files.select("path"), "path", "left_anti").groupBy("path").agg(F.count("*").alias("n")).select(F.lit("unknown group member").alias("problem"), "path", "n")
    repeated = groups.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated group member").alias("problem"), "path", "n")
    return twice.unionByName(unknown).unionByName(repeated)


def metadata_json(metadata: Column) -> Column:
    """JSON in field order, without null fields; null for no metadata."""
    return F.to_json(metadata)


def build(export: RunExport, run_id: int, started: Column | None = None) -> dict[str, DataFrame]:
    """The rows of all four tables for one run."""
    now = F.current_timestamp() if started is None else started
    has = lambda c: F.col(c) if c in export.files.columns else F.lit(None)
    # the paths' order gives the ids, so that building twice gives the same ones
    numbered = _ids(export.files, "path")
    ids = numbered.select("path", "id")
    sizes = export.groups.groupBy("group_number", "media_type").agg(F.count("*").alias("file_count"), F.first("target_path", True).alias("target_path") if "target_path" in export.groups.columns else F.lit(None).cast("string").alias("target_path"))
    sizes = sizes.withColumn("id", F.col("group_number").cast("bigint"))
    best = sizes.select("group_number", F.col("target_path").alias("path")).join(export.groups.select("group_number", "path"), ["group_number", "path"]).join(ids, "path").select("group_number", F.col("id").alias("best_file_id"))
    members = export.groups.select("path", F.col("group_number").cast("bigint").alias("group_id"))
    files = numbered.join(members, "path", "left").select(
        "id", F.lit(run_id).cast("bigint").alias("run_id"), "group_id", "path", F.coalesce(has("filename").cast("string"), basename(F.col("path"))).alias("filename"), "media_type", F.col("size_bytes").cast("bigint").alias("size_bytes"),
        has("content_hash").cast("string").alias("content_hash"), report_time(has("creation_date").cast("timestamp")).alias("creation_date"), has("quality_score").cast("double").alias("quality_score"),
        (metadata_json(F.col("metadata")) if dict(export.files.dtypes).get("metadata", "").startswith("struct") else has("metadata").cast("string")).alias("metadata"),
    )
    groups = sizes.join(best, "group_number", "left").select("id", F.lit(run_id).cast("bigint").alias("run_id"), F.col("group_number").cast("bigint").alias("group_number"), "media_type", "file_count", "best_file_id", "target_path")
    operations = _ids(export.operations, "source", "operation").join(ids.select(F.col("path").alias("source"), F.col("id").alias("media_file_id")), "source", "left").select(
        "id", F.lit(run_id).cast("bigint").alias("run_id"), "media_file_id", "operation", "status", "source", "destination", default_time(now).alias("created_at")
    )
    totals = export.files.agg(F.count("*").alias("total_files")).crossJoin(export.groups.agg(F.count("*").alias("duplicate_count")))
    runs = totals.select(
        F.lit(run_id).cast("bigint").alias("id"), F.lit(export.root_path).alias("root_path"), F.lit(export.status).alias("status"), default_time(now).alias("started_at"),
        F.when(F.lit(export.status in TERMINAL), default_time(now)).alias("completed_at"), "total_files", "duplicate_count", F.lit(export.notes).cast("string").alias("notes"),
    )
    return {"report_runs": runs, "media_files": files, "duplicate_groups": groups, "operations": operations}


def _ids(df: DataFrame, *order: str) -> DataFrame:
    """Opaque ids, unique within the run; stored at once, since several tables refer to them."""
    ws = Workspace(df.sparkSession, "ids")
    return ws.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id() + 1), "ids")


class ReportStore:
    """Readers and all-or-nothing writers of report tables under one root folder."""

    KEPT = 20  # manifests of older versions that stay

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark)

    def version(self) -> int:
        """The version of the store; 0 is the empty one."""
        found = (re.fullmatch(r"manifest-(\d+)\.json", name) for name in self.files.names(self.root))
        return max((int(m[1]) for m in found if m), default=0)

    # manifest: {run_id: {table: [paths]}}
    def manifest(self, version: int | None = None) -> dict[str, dict[str, list[str]]]:
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"{self.root}/manifest-{version:09d}.json")) if version else {}

    def _publish(self, manifest: dict, after: int) -> None:
        if not self.files.create(f"{self.root}/manifest-{after + 1:09d}.json", json.dumps(manifest, sort_keys=True)):
            raise ReportError("the store was changed by another writer", operation="publish", details={"version": after + 1})
        if after + 1 > self.KEPT:
            self.files.delete(f"{self.root}/manifest-{after + 1 - self.KEPT:09d}.json")

    def _write(self, name: str, run: int, df: DataFrame) -> str:
        path = f"{self.root}/{name}/run_id={run}/attempt={uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def export(self, export: RunExport, run_id: int | None = None) -> int:
        """Write a run, replacing the one of that id; raises before anything is visible if the input is inconsistent."""
        version = self.version()
        manifest = self.manifest(version)
        if run_id is not None and str(run_id) not in manifest:
            raise ReportError("the run to replace doesn't exist", operation="export_run", details={"run_id": run_id})
        if problem := violations(export.files, export.groups).first():
            raise ReportError(problem["problem"], operation="export_run", file_path=problem["path"])
        run = run_id if run_id is not None else self._new_run(manifest)
        paths = {name: [self._write(name, run, df)] for name, df in build(export, run).items()}
        self._publish(manifest | {str(run): paths}, version)
        return run

    @staticmethod
    def _new_run(manifest: dict) -> int:
        return max(map(int, manifest), default=0) + 1

    def table(self, name: str, run_id: int | None = None) -> DataFrame:
        paths = [path for r, p in self.manifest().items() if run_id is None or int(r) == run_id for path in p.get(name, [])]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def rewrite(self, run_id: int, changed: dict[str, DataFrame]) -> None:
        """Publish new versions of some tables of a run (copy on write)."""
        version = self.version()
        manifest = self.manifest(version)
        if str(run_id) not in manifest:
            raise ReportError("no such run", details={"run_id": run_id})
        for name, df in changed.items():
            manifest[str(run_id)][name] = [self._write(name, run_id, df)]
        self._publish(manifest, version)

    def _append(self, name: str, run_id: int, values: dict) -> int:
        """One more row of a run's table, as a folder of its own; returns its id, the next one of the run."""
        version = self.version()
        manifest = self.manifest(version)
        if str(run_id) not in manifest:
            raise ReportError("no such run", details={"run_id": run_id})
        ident = (self.table(name, run_id).agg(F.max("id")).first()[0] or 0) + 1
        fields = schema(name).fieldNames()
        if unknown := set(values) - set(fields):
            raise ReportError(f"no such column: {min(unknown)}", operation=name)
        row = {"id": ident, "run_id": run_id} | values
        if (run_domain := DOMAINS.get((name, "media_type"))) and row.get("media_type") not in run_domain:
            raise ReportError(f"not a media type: {row.get('media_type')}", operation=name)
        for column in ("status", "operation"):
            if (domain := DOMAINS.get((name, column))) and row.get(column) not in domain:
                raise ReportError(f"not a {column}: {row.get(column)}", operation=name)
        df = self.spark.createDataFrame([tuple(row.get(f) for f in fields)], SCHEMAS[name])
        manifest[str(run_id)].setdefault(name, []).append(self._write(name, run_id, df))
        self._publish(manifest, version)
        return ident

    def create_run(self, root_path: str, status: str = "running", notes: str | None = None) -> int:
        """A run without files yet; returns its id."""
        if status not in DOMAINS["report_runs", "status"]:
            raise ReportError(f"not a status: {status}", operation="create_run")
        version = self.version()
        manifest = self.manifest(version)
        run = self._new_run(manifest)
        now = default_time(F.current_timestamp())
        row = self.spark.range(1).select(
            F.lit(run).cast("bigint").alias("id"), F.lit(root_path).alias("root_path"), F.lit(status).alias("status"), now.alias("started_at"), F.when(F.lit(status in TERMINAL), now).alias("completed_at"),
            F.lit(0).cast("bigint").alias("total_files"), F.lit(0).cast("bigint").alias("duplicate_count"), F.lit(notes).cast("string").alias("notes"),
        )
        self._publish(manifest | {str(run): {"report_runs": [self._write("report_runs", run, row)]}}, version)
        return run

    def add_media_file(self, run_id: int, path: str, media_type: str, size_bytes: int, **values: object) -> int:
        """A file of a run; further columns by name. Paths must not repeat within the run."""
        if self.table("media_files", run_id).where(F.col("path") == path).take(1):
            raise ReportError("duplicate path", operation="add_media_file", file_path=path)
        return self._append("media_files", run_id, {"filename": path.rsplit("/", 1)[-1], "path": path, "media_type": media_type, "size_bytes": size_bytes} | values)

    def add_duplicate_group(self, run_id: int, group_number: int, media_type: str, file_count: int = 0, **values: object) -> int:
        if self.table("duplicate_groups", run_id).where(F.col("group_number") == group_number).take(1):
            raise ReportError("duplicate group number", operation="add_duplicate_group", details={"group_number": group_number})
        return self._append("duplicate_groups", run_id, {"group_number": group_number, "media_type": media_type, "file_count": file_count} | values)

    def add_operation(self, run_id: int, operation: str, status: str, source: str | None = None, destination: str | None = None) -> int:
        """An operation of a run; its file is the one its source names, if it is known."""
        known = self.table("media_files", run_id).where(F.col("path") == source).select("id").first() if source else None
        at = self.spark.range(1).select(default_time(F.current_timestamp())).first()[0]
        return self._append("operations", run_id, {"operation": operation, "status": status, "source": source, "destination": destination, "media_file_id": known["id"] if known else None, "created_at": at})

    def list_runs(self) -> DataFrame:
        return self.table("report_runs").orderBy("started_at", "id")

    def list_media_files(self, run_id: int) -> DataFrame:
        return self.table("media_files", run_id).orderBy("path", "id")

    def list_groups(self, run_id: int) -> DataFrame:
        return self.table("duplicate_groups", run_id).orderBy("group_number")

    def list_operations(self, run_id: int) -> DataFrame:
        return self.table("operations", run_id).orderBy("created_at", "id")

    def update_run(self, run_id: int, status: str, total_files: int | None = None, duplicate_count: int | None = None) -> None:
        """Terminal statuses record the time of completion, others clear it; counters not given keep their values."""
        done = F.lit(status in TERMINAL)
        runs = self.table("report_runs", run_id).select(
            "id", "root_path", F.lit(status).alias("status"), "started_at", F.when(done, default_time(F.current_timestamp())).alias("completed_at"),
            F.coalesce(F.lit(total_files).cast("bigint"), "total_files").alias("total_files"), F.coalesce(F.lit(duplicate_count).cast("bigint"), "duplicate_count").alias("duplicate_count"), "notes",
        )
        self.rewrite(run_id, {"report_runs": runs})

    def delete_group(self, run_id: int, group_number: int) -> int:
        """Drop a group and detach its members; how many groups went."""
        if not (n := self.table("duplicate_groups", run_id).where(F.col("group_number") == group_number).count()):
            return 0
        gone = F.col("group_id") == group_number
        files = self.table("media_files", run_id).withColumn("group_id", F.when(~F.coalesce(gone, F.lit(False)), F.col("group_id")))
        self.rewrite(run_id, {"duplicate_groups": self.table("duplicate_groups", run_id).where(F.col("group_number") != group_number), "media_files": files})
        return n

    def set_best_file(self, run_id: int, group_number: int, file_id: int) -> int:
        """How many groups were changed."""
        if not (n := self.table("duplicate_groups", run_id).where(F.col("group_number") == group_number).count()):
            return 0
        best = F.when(F.col("group_number") == group_number, F.lit(file_id).cast("bigint")).otherwise(F.col("best_file_id"))
        self.rewrite(run_id, {"duplicate_groups": self.table("duplicate_groups", run_id).withColumn("best_file_id", best)})
        return n

    def assign_group(self, run_id: int, file_id: int, group_number: int | None) -> int:
        """How many files were changed."""
        if not (n := self.table("media_files", run_id).where(F.col("id") == file_id).count()):
            return 0
        group = F.when(F.col("id") == file_id, F.lit(group_number).cast("bigint")).otherwise(F.col("group_id"))
        self.rewrite(run_id, {"media_files": self.table("media_files", run_id).withColumn("group_id", group)})
        return n

    def update_metadata(self, run_id: int, file_id: int, metadata: str | None) -> int:
        """How many files were changed."""
        if not (n := self.table("media_files", run_id).where(F.col("id") == file_id).count()):
            return 0
        text = F.when(F.col("id") == file_id, F.lit(metadata).cast("string")).otherwise(F.col("metadata"))
        self.rewrite(run_id, {"media_files": self.table("media_files", run_id).withColumn("metadata", text)})
        return n

    def delete_run(self, run_id: int) -> bool:
        """Whether there was such a run."""
        version = self.version()
        manifest = self.manifest(version)
        if manifest.pop(str(run_id), None) is None:
            return False
        self._publish(manifest, version)
        return True
