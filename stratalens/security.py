"""Paths that must stay within allowed roots; links on the way are found without resolving dots first."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path, PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.errors import SecurityError


def within(path: Column, roots: Iterable[str]) -> Column:
    """True for normalised paths equal to a root or below one."""
    result = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        result = result | (path == (root or "/")) | path.startswith(f"{root}/")
    return result & ~path.rlike(r"(?:\A|/)\.\.?(?:/|\z)")


def links_on(path: str | Path) -> list[Path]:
    """The components of a path that are symbolic links, dots taken as they come."""
    found, at = [], Path(PurePosixPath(path).anchor or ".")
    for part in PurePosixPath(path).parts[bool(PurePosixPath(path).anchor) :]:
        at = at / part
        if part != ".." and at.is_symlink():
            found.append(at)
    return found


def validate(path: str | Path, roots: Iterable[str | Path], allow_links: bool = False) -> Path:
    """The resolved path; raises if it leaves the roots, holds a NUL, or passes a link that isn't allowed."""
    if "\0" in str(path):
        raise SecurityError("path holds a NUL character", operation="validate")
    if not allow_links and (links := links_on(path)):
        raise SecurityError("path passes a symbolic link", operation="validate", file_path=str(links[0]))
    resolved = Path(os.path.realpath(path))
    if not any(resolved == r or r in resolved.parents for r in (Path(os.path.realpath(root)) for root in roots)):
        raise SecurityError("path is outside the allowed folders", operation="validate", file_path=str(path))
    return resolved
