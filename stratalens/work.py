"""The shared work folder: tables written there cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTING = "spark.checkpoint.dir"


def sound(spark: SparkSession) -> None:
    """Switch off a planner rule of Spark 4.1 that loses rows of groups.

    A union whose inputs are hash-partitioned alike is taken to be so itself, and an aggregation or join over it by the
    same keys does without a shuffle; but adaptive execution may have coalesced the inputs' partitions differently, and
    then rows of one key stay apart. Reproduced in tests/test_skew.py.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def work_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it is unset (tests), an own one."""
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


class SharedFiles:
    """Small text files on the shared file system, by the session's Hadoop configuration."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.conf), target

    def exists(self, path: str) -> bool:
        files, target = self._at(path)
        return files.exists(target)

    def names(self, folder: str) -> list[str]:
        files, target = self._at(folder)
        return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []

    def read(self, path: str) -> str:
        files, target = self._at(path)
        stream = files.open(target)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file, which appears whole or not at all; False if there is one of that name."""
        files, target = self._at(path)
        if files.exists(target):
            return False
        _, draft = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = files.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not files.exists(target) and files.rename(draft, target):
            return True
        files.delete(draft, False)
        return False

    def size(self, folder: str) -> int:
        """Bytes of all files in a folder and below."""
        files, target = self._at(folder)
        return files.getContentSummary(target).getLength()

    def stamp(self, path: str) -> str:
        """Length and time of a file's last change."""
        files, target = self._at(path)
        status = files.getFileStatus(target)
        return f"{status.getLen()}:{status.getModificationTime()}"

    def delete(self, path: str) -> None:
        files, target = self._at(path)
        files.delete(target, True)


class Workspace:
    """A private subfolder of the work folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        sound(spark)
        self.spark = spark
        self.root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str = "t", split: tuple[str, ...] = (), to: DataFrame | None = None) -> DataFrame:
        """Write df as a table and read it back: a stable copy without lineage. split names columns of few values by which
        the files are parted, so that a filter on them reads only its own. With `to` the rows go to that stored table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}" if to is None else self._paths[id(to)][1]
        df.write.mode("append").partitionBy(*split).parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(stored)] = stored, path
        return stored

    def save_observed(self, df: DataFrame, name: str, *metrics: Column, split: tuple[str, ...] = (), to: DataFrame | None = None) -> tuple[DataFrame, dict]:
        """save(), with aggregates of df that are computed while it is written."""
        seen = Observation()
        return self.save(df.observe(seen, *metrics), name, split, to), dict(seen.get)

    def forget(self, *tables: DataFrame) -> None:
        """Delete tables that save() returned and no later one needs; others are left alone."""
        for table in tables:
            if known := self._paths.pop(id(table), None):
                self.drop(known[1])

    def drop(self, path: str | None = None) -> None:
        """Delete the folder; called at the end of the process, when results have been read."""
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path or self.root)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def stored_path(df: DataFrame, name: str, make: Callable[[str], object]) -> str:
    """Where make(path) wrote its tables: in the work folder under the files that df reads, so that the next call finds them.

    df must be a whole table with some of its columns: a filter on it would not tell. Files that change make a new path;
    a file DONE beside the tables tells that they are complete.
    """
    spark = df.sparkSession
    files = SharedFiles(spark)
    stamp = hashlib.sha256(f"{name}:{df.schema.json()}".encode())
    for file in sorted(df.inputFiles()):
        stamp.update(f"{file}:{files.stamp(file)}".encode())
    path = f"{work_dir(spark)}/{name}-{stamp.hexdigest()[:32]}"
    if not files.exists(f"{path}.DONE"):
        files.delete(path)  # what a broken attempt left
        make(path)
        files.create(f"{path}.DONE", "")
    return path


def stored_once(df: DataFrame, name: str, make: Callable[[str], object]) -> DataFrame:
    """The table that make(path) wrote, by stored_path()."""
    return df.sparkSession.read.parquet(stored_path(df, name, make))
