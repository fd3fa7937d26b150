"""Versions of a folder of tables: a version file beside them, raised step by step, each step as a whole."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from stratalens.errors import ReportError

Migration = tuple[int, Callable[[Path], None]]


def history(root: str | Path) -> list[dict]:
    path = Path(root, "versions.json")
    return json.loads(path.read_text()) if path.exists() else []


def version(root: str | Path) -> int:
    """The highest version applied, 0 for a new folder."""
    return max((row["version"] for row in history(root)), default=0)


def missing(root: str | Path) -> list[int]:
    """Versions below the current one that were never recorded."""
    known = {row["version"] for row in history(root)}
    return sorted(set(range(1, version(root) + 1)) - known)


def check(migrations: list[Migration]) -> None:
    numbers = [n for n, _ in migrations]
    if any(b != a + 1 for a, b in zip(numbers, numbers[1:], strict=False)):
        raise ReportError("migrations must be consecutive and in order", details={"versions": numbers})


def apply(root: str | Path, target: int, baseline: Callable[[Path], None], migrations: list[Migration], applied_at: str) -> list[int]:
    """New folders get the baseline at `target`; others every migration up to it. Returns the versions written."""
    check(migrations)
    root = Path(root)
    root.mkdir(parents=True, exist_ok=True)
    now = version(root)
    if now > target:
        raise ReportError("the tables are newer than this program", details={"found": now, "known": target})
    if now and (gaps := missing(root)):
        raise ReportError("versions are missing", details={"missing": gaps})
    steps = [(target, baseline)] if now == 0 else [m for m in migrations if now < m[0] <= target]
    if now and steps and [n for n, _ in steps] != list(range(now + 1, target + 1)):
        raise ReportError("no way from the folder's version to the target", details={"found": now, "target": target})
    for number, step in steps:
        step(root)
        known = {row["version"] for row in history(root)}
        new = [{"version": n, "applied_at": applied_at} for n in (range(1, number + 1) if not known else [number])]
        rows = history(root) + new
        temporary = root / f".{uuid.uuid4().hex}"
        temporary.write_text(json.dumps(rows))
        os.replace(temporary, root / "versions.json")
    return [n for n, _ in steps]
