"""Sessions and their reversible commands as append-only logs with latest-state views."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.errors import PipelineError
from stratalens.functions.dates import log_time, session_id
from stratalens.schemas import DOMAINS
from stratalens.work import SharedFiles


def latest_state(events: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The state of every key after its last event; later null values keep earlier ones."""
    keep = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return events.groupBy(*key).agg(*keep)


def with_command_counts(sessions: DataFrame, commands: DataFrame) -> DataFrame:
    """sessions plus command_count, 0 without commands."""
    counts = commands.groupBy("session_id").agg(F.count("*").alias("command_count"))
    return sessions.join(counts, "session_id", "left").fillna({"command_count": 0})


def newest_sessions(sessions: DataFrame, limit: int = -1) -> DataFrame:
    ordered = sessions.orderBy(F.col("started_at").desc(), F.col("session_id").desc())
    return ordered if limit < 0 else ordered.limit(limit)


def command_page(commands: DataFrame, session_id: str, limit: int = -1, offset: int = 0) -> DataFrame:
    page = commands.where(F.col("session_id") == session_id).orderBy("seq").offset(offset)
    return page if limit < 0 else page.limit(limit)


def latest_completed(sessions: DataFrame) -> DataFrame:
    return sessions.where("status = 'completed'").orderBy(F.col("completed_at").desc(), F.col("session_id").desc()).limit(1)


def interrupted(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count_if(F.col("status") == "interrupted").alias("n"))


def mark_interrupted(sessions: DataFrame) -> DataFrame:
    """What is still running when the log is opened was interrupted."""
    return sessions.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def deletable(sessions: DataFrame, before: str | None = None, keep: tuple[str, ...] = ("running",)) -> DataFrame:
    """Sessions of other statuses, older than a cutoff if one is given."""
    old: Column = F.lit(True) if before is None else F.col("started_at") < before
    return sessions.where(~F.col("status").isin(*keep) & old)


def delete_sessions(sessions: DataFrame, commands: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in gone and their commands."""
    keys = gone.select("session_id").distinct()
    return sessions.join(keys, "session_id", "left_anti"), commands.join(keys, "session_id", "left_anti")


def pending_undo(commands: DataFrame) -> DataFrame:
    """The commands to reverse, last first."""
    return commands.where("status = 'done'").orderBy(F.col("seq").desc())


EVENT = "n bigint, kind string, session_id string, seq bigint, command_type string, args_json string, log_json string, status string, source string, destination string, config_digest string, at string"
SESSION_STATUSES, COMMAND_STATUSES = DOMAINS["sessions", "status"], DOMAINS["commands", "status"]


def log_json(values: dict | None) -> str | None:
    """JSON with sorted keys."""
    return None if values is None else json.dumps(values, sort_keys=True)


def args_json(values: dict) -> str:
    """The arguments of a command, tagged with the version of their form."""
    return log_json({"schema": 1, **values})


def session_view(events: DataFrame) -> DataFrame:
    """The sessions after all events: what later events leave null stays as it was."""
    state = latest_state(events.where("kind = 'session'"), ["session_id"], "n", ["status", "config_digest", "source", "destination"])
    times = events.where("kind = 'session'").groupBy("session_id").agg(F.min_by("at", "n").alias("started_at"), F.max_by(F.when(F.col("status") != "running", F.col("at")), "n").alias("completed_at"))
    return times.join(state, "session_id")


def command_view(events: DataFrame) -> DataFrame:
    """The commands after all events."""
    state = latest_state(events.where("kind = 'command'"), ["seq"], "n", ["session_id", "command_type", "args_json", "log_json", "status"])
    times = events.where("kind = 'command'").groupBy("seq").agg(F.min_by("at", "n").alias("started_at"), F.max_by(F.when(F.col("status") != "in_progress", F.col("at")), "n").alias("completed_at"))
    return times.join(state, "seq")


class SagaLog:
    """An append-only log of sessions and reversible commands; the views are computed from its events.

    Every event is one file of the shared file system, numbered without gaps and created only if there is none of its
    number, so two writers never take the same one; compact() puts the files of older events together.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark)

    def _last(self) -> int:
        names = [*self.files.names(f"{self.root}/events"), *self.files.names(f"{self.root}/done")]
        return max((int(name.split(".")[0].split("=")[-1]) for name in names if re.fullmatch(r"(upto=)?\d+(\.json)?", name)), default=0)

    def _write(self, **event: object) -> int:
        event["at"] = self.spark.range(1).select(log_time(F.current_timestamp())).first()[0]
        while True:  # another writer may take the number first
            n = self._last() + 1
            if self.files.create(f"{self.root}/events/{n:012d}.json", log_json({"n": n, **{k: v for k, v in event.items() if v is not None}})):
                return n

    def events(self) -> DataFrame:
        parts = [self.spark.createDataFrame([], EVENT)]
        upto = max((int(n.split("=")[1]) for n in self.files.names(f"{self.root}/done") if n.startswith("upto=")), default=0)
        if upto:
            parts.append(self.spark.read.schema(EVENT).parquet(f"{self.root}/done/upto={upto:012d}"))
        if fresh := [f"{self.root}/events/{n}" for n in self.files.names(f"{self.root}/events") if re.fullmatch(r"\d+\.json", n) and int(n[:-5]) > upto]:
            parts.append(self.spark.read.schema(EVENT).json(fresh))
        return reduce(DataFrame.unionByName, parts)

    def compact(self) -> None:
        """One table of all events so far; their files go once it is there."""
        last, old = self._last(), self.files.names(f"{self.root}/done")
        self.events().coalesce(1).write.parquet(f"{self.root}/done/upto={last:012d}")
        for name in self.files.names(f"{self.root}/events"):
            if re.fullmatch(r"\d+\.json", name) and int(name[:-5]) <= last:
                self.files.delete(f"{self.root}/events/{name}")
        for name in old:
            self.files.delete(f"{self.root}/done/{name}")

    def sessions(self) -> DataFrame:
        return session_view(self.events())

    def commands(self) -> DataFrame:
        return command_view(self.events())

    def create_session(self, source: str, destination: str, config_digest: str, token: str | None = None) -> str:
        token = token or uuid.uuid4().hex
        ident = self.spark.range(1).select(session_id(F.current_timestamp(), F.lit(token))).first()[0]
        self._write(kind="session", session_id=ident, status="running", source=source, destination=destination, config_digest=config_digest)
        return ident

    def append_command(self, session: str, command_type: str, args: dict) -> int:
        """A command about to run; its seq. The session must be running."""
        if self._status("session", session) != "running":
            raise PipelineError("the session isn't running", details={"session_id": session})
        seq = (self.events().where("kind = 'command'").agg(F.max("seq")).first()[0] or 0) + 1
        self._write(kind="command", session_id=session, seq=seq, command_type=command_type, args_json=args_json(args), status="in_progress")
        return seq

    def _status(self, kind: str, key: object) -> str | None:
        column = "session_id" if kind == "session" else "seq"
        row = self.events().where((F.col("kind") == kind) & (F.col(column) == key)).agg(F.max_by("status", "n")).first()
        return row[0]

    def mark_command(self, seq: int, status: str, log: dict | None = None) -> None:
        if status not in COMMAND_STATUSES:
            raise PipelineError(f"not a status of commands: {status}")
        if self._status("command", seq) is None:
            raise PipelineError("no such command", details={"seq": seq})
        self._write(kind="command", seq=seq, status=status, log_json=log_json(log))

    def mark_done(self, seq: int, log: dict | None = None) -> None:
        """Only a command in progress becomes done, and only once."""
        if (now := self._status("command", seq)) != "in_progress":
            raise PipelineError("the command isn't in progress", details={"seq": seq, "status": now})
        self.mark_command(seq, "done", log)

    def finish_session(self, session: str, status: str = "completed") -> None:
        if status not in SESSION_STATUSES or status == "running":
            raise PipelineError(f"not a final status of sessions: {status}")
        if self._status("session", session) is None:
            raise PipelineError("no such session", details={"session_id": session})
        self._write(kind="session", session_id=session, status=status)

    def mark_interrupted(self) -> int:
        """Sessions still running when the log is opened were interrupted; how many."""
        running = [r.session_id for r in self.sessions().where("status = 'running'").select("session_id").toLocalIterator()]
        for session in running:
            self._write(kind="session", session_id=session, status="interrupted")
        return len(running)
