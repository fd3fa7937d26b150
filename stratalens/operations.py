"""Reversible file operations on the driver: each step is logged, and undone in reverse order if a later one fails."""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from types import TracebackType

from stratalens.errors import FileOperationError

TRASH = ".stratalens-staging"


@dataclass
class Step:
    operation: str
    source: str | None = None
    destination: str | None = None
    created: list[str] = field(default_factory=list)
    backup: str | None = None
    status: str = "applied"

    def as_dict(self) -> dict:
        return {k: v for k, v in vars(self).items() if v}


def _whole_copy(source: Path, destination: Path) -> None:
    """A copy under its final name only when all of it is on the disk; an existing file stays."""
    temporary = destination.with_name(f".{uuid.uuid4().hex}")
    try:
        shutil.copy2(source, temporary)
        with open(temporary, "rb") as file:
            os.fsync(file.fileno())
        os.link(temporary, destination)
    finally:
        temporary.unlink(missing_ok=True)


def _moved(source: Path, destination: Path) -> None:
    """A rename, or, across devices, a whole copy before the source goes."""
    try:
        os.rename(source, destination)
    except OSError:
        _whole_copy(source, destination)
        source.unlink()


class FileTransaction:
    """Use as a context: leaving it normally keeps everything, an exception rolls back."""

    def __init__(self) -> None:
        self.log: list[Step] = []

    def __enter__(self) -> FileTransaction:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if kind:
            self.rollback()
        else:
            for step in self.log:
                if step.operation == "delete" and step.backup:
                    Path(step.backup).unlink(missing_ok=True)

    def _place(self, source: Path, destination: Path) -> Path:
        if not source.is_file():
            raise FileOperationError("no such file", operation="place", file_path=str(source))
        if destination.exists():
            raise FileOperationError("the destination exists", operation="place", file_path=str(destination))
        self.mkdir(destination.parent)
        return destination

    def mkdir(self, path: str | Path) -> None:
        path, made = Path(path), []
        while not path.exists():
            made.append(path)
            path = path.parent
        for folder in reversed(made):
            folder.mkdir()
        if made:
            self.log.append(Step("mkdir", None, str(made[0]), [str(p) for p in made]))

    def copy(self, source: str | Path, destination: str | Path) -> None:
        """By a temporary file in the destination's folder, so that a copy is there as a whole or not at all."""
        source, destination = Path(source), Path(destination)
        self._place(source, destination)
        _whole_copy(source, destination)
        self.log.append(Step("copy", str(source), str(destination)))

    def move(self, source: str | Path, destination: str | Path) -> None:
        source, destination = Path(source), Path(destination)
        self._place(source, destination)
        _moved(source, destination)
        self.log.append(Step("move", str(source), str(destination)))

    def delete(self, path: str | Path) -> None:
        """Set aside first, gone for good when the transaction succeeds."""
        path = Path(path)
        if not path.is_file():
            raise FileOperationError("no such file", operation="delete", file_path=str(path))
        aside = path.with_name(f".{uuid.uuid4().hex}.deleted")
        os.rename(path, aside)
        self.log.append(Step("delete", str(path), backup=str(aside)))

    def rollback(self) -> None:
        for step in reversed(self.log):
            if step.status != "applied":
                continue
            if step.operation == "move":
                _moved(Path(step.destination), Path(step.source))
            elif step.operation == "copy":
                Path(step.destination).unlink(missing_ok=True)
            elif step.operation == "delete":
                os.rename(step.backup, step.source)
            else:
                for folder in step.created:
                    if Path(folder).is_dir() and not any(Path(folder).iterdir()):
                        Path(folder).rmdir()
            step.status = "rolled_back"


#: Kinds of commands: what they do to their paths.
COMMANDS = ("move_file", "copy_file", "delete_file", "create_directory")


@dataclass
class Command:
    """A file operation that can be written down, executed once and reversed once."""

    command: str
    source: str | None = None
    destination: str | None = None
    log: list[Step] = field(default_factory=list)
    status: str = "pending"

    def __post_init__(self) -> None:
        if self.command not in COMMANDS:
            raise FileOperationError(f"no such command: {self.command}")
        if (self.command != "create_directory" and not self.source) or (self.command != "delete_file" and not self.destination):
            raise FileOperationError("the command lacks a path", operation=self.command)

    def execute(self) -> None:
        if self.status != "pending":
            raise FileOperationError("the command ran already", operation=self.command)
        work = FileTransaction()
        try:
            if self.command == "move_file":
                work.move(self.source, self.destination)
            elif self.command == "copy_file":
                work.copy(self.source, self.destination)
            elif self.command == "delete_file":
                work.delete(self.source)
            else:
                work.mkdir(self.destination)
        except BaseException:
            work.rollback()
            self.status = "failed"
            raise
        self.log, self.status = work.log, "done"

    def undo(self) -> None:
        if self.status != "done":
            raise FileOperationError("only a command that ran can be undone", operation=self.command)
        _logged(self.log).rollback()
        self.status = "undone"

    def discard(self) -> None:
        """A deletion becomes final: what it set aside goes, and it can't be undone any more."""
        if self.status == "done" and self.command == "delete_file":
            FileTransaction.__exit__(_logged(self.log), None, None, None)
            self.status = "final"

    def as_dict(self) -> dict:
        return {"command": self.command, "source": self.source, "destination": self.destination, "status": self.status, "log": [step.as_dict() for step in self.log]}

    @classmethod
    def from_dict(cls, values: dict) -> Command:
        return cls(values["command"], values.get("source"), values.get("destination"), [Step(**step) for step in values.get("log", [])], values.get("status", "pending"))


def _logged(log: list[Step]) -> FileTransaction:
    work = FileTransaction()
    work.log = log
    return work



def remove_empty_tree(root: str | Path, patterns: tuple[str, ...] = (), keep_root: bool = True) -> list[str]:
    """Remove directories without files below them, children first; excluded ones and links keep their parents."""
    from stratalens.operators.inventory import fnmatch_any

    root, removed, kept = Path(root), [], set()
    for folder, dirs, files in os.walk(root, topdown=False):
        path = Path(folder)
        rel = path.relative_to(root).as_posix()
        blocked = files or any(Path(folder, d).is_symlink() or Path(folder, d) in kept for d in dirs) or (rel != "." and any(fnmatch_any(p, "/".join(rel.split("/")[: i + 1]), list(patterns)) for i, p in enumerate(rel.split("/"))))
        if blocked or (path == root and keep_root):
            kept.add(path)
        else:
            path.rmdir()
            removed.append(str(path))
    return removed


def backup(path: str | Path, folder: str | Path) -> Path:
    """A copy under a unique name in a folder that must not hold the original."""
    path, folder = Path(path), Path(folder)
    if folder.resolve() == path.resolve() or path.resolve() in folder.resolve().parents:
        raise FileOperationError("the backup folder lies within what is backed up", operation="backup", file_path=str(path))
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"{path.name}.{uuid.uuid4().hex}"
    shutil.copy2(path, target)
    return target


def restore(copy: str | Path, path: str | Path) -> None:
    temporary = Path(path).with_name(f".{uuid.uuid4().hex}")
    shutil.copy2(copy, temporary)
    os.replace(temporary, path)
