"""Directory listings as tables: filters, walk order, statistics, empty directories.

A listing has rel (path below the root, without leading slash), is_dir, is_symlink, size, mtime and media_type.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import basename

#: Work folders that are never walked, besides everything that begins with a dot.
OWN_FOLDERS = (".stratalens-backups", ".stratalens-staging")
STILLS, VIDEOS = ("heic", "heif", "jpg", "jpeg"), ("mov",)


def prefixes(rel: Column) -> Column:
    """The path itself and all its ancestors."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored Java regex; the star crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = close
        else:
            out += c if c.isalnum() or ord(c) > 127 else "\\" + c
        i += 1
    return rf"(?s)\A{out}\z"


def excluded(rel: Column, patterns: list[str]) -> Column:
    """True if the entry or one of its ancestors matches a pattern by its name or by its path below the root."""
    result = F.lit(False)
    for regex in map(glob_regex, patterns):
        result = result | F.exists(prefixes(rel), _matches(regex))
    return result


def _matches(regex: str):
    return lambda entry: entry.rlike(regex) | basename(entry).rlike(regex)


def hidden(rel: Column) -> Column:
    """True if a component begins with a dot (own work folders do)."""
    return rel.rlike(r"(?:\A|/)\.[^/]*")


def depth(rel: Column) -> Column:
    """Directories between the root and the entry."""
    return F.size(F.split(rel, "/")) - 1


def walk_key(rel: Column) -> Column:
    """Sorts as a walk visits: in every directory files by name, then subdirectories by name."""
    parts = F.split(rel, "/")
    return F.transform(parts, lambda name, i: F.struct((i < F.size(parts) - 1).alias("in_dir"), name.alias("name")))


def discover(listing: DataFrame, patterns: list[str] | None = None, max_depth: int | None = None, symlinks: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(media files in walk order, issues) of a listing; symlinks: skip, follow (needs a resolved column) or error."""
    kept = listing.where(~F.col("is_dir") & ~hidden(F.col("rel")))
    if patterns:
        kept = kept.where(~excluded(F.col("rel"), patterns))
    if max_depth is not None:
        kept = kept.where(depth(F.col("rel")) <= max_depth)
    links = kept.where("is_symlink")
    if symlinks == "follow":
        ordered = kept.withColumn("key", walk_key(F.col("rel"))).withColumn("target", F.coalesce("resolved", "rel"))
        first = ordered.groupBy("target").agg(F.min_by("rel", "key").alias("rel"))
        issues = ordered.join(first, ["target", "rel"], "left_anti").select("rel", F.lit("same file as one seen before").alias("message"))
        kept = kept.join(first.select("rel"), "rel", "left_semi")
    else:
        message = "symbolic link skipped" if symlinks == "skip" else "symbolic link not allowed"
        issues = links.select("rel", F.lit(message).alias("message"))
        kept = kept.where(~F.col("is_symlink"))
    return kept.where(F.col("media_type").isNotNull()).orderBy(walk_key(F.col("rel"))), issues


def directory_stats(files: DataFrame, media_type: str, size: str, mtime: Column) -> DataFrame:
    """One row: n_files, total_bytes, counts_by_type, n_unknown, oldest, newest; all zero or null for an empty table."""
    by_type = files.groupBy(F.col(media_type).alias("t")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.min(mtime).alias("lo"), F.max(mtime).alias("hi"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "n")))))  # one entry per media type
    return by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), counts.alias("counts_by_type"),
        F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n"))), F.lit(0)).alias("n_unknown"), F.min("lo").alias("oldest"), F.max("hi").alias("newest"),
    )


def empty_directories(dirs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """The removable directories of (rel, has_files, is_symlink), children before parents.

    A directory stays if it or anything below it holds files, is excluded or is a symbolic link; so the ones to keep
    are the ancestors of such directories, found without iteration.
    """
    stays = F.col("has_files") | F.col("is_symlink")
    if patterns:
        stays = stays | excluded(F.col("rel"), patterns)
    kept = dirs.where(stays).select(F.explode(prefixes(F.col("rel"))).alias("rel")).distinct()
    tail = F.transform(F.split("rel", "/"), lambda name: F.concat(name, F.lit("/")))
    # postorder: a directory sorts after everything below it
    return dirs.join(kept, "rel", "left_anti").select("rel").orderBy(F.concat(tail, F.array(F.lit("\U0010ffff"))))


def progress(found: DataFrame, every: int = 100) -> DataFrame:
    """(accepted, rel) of the files at which progress is told: each `every`-th of the walk, and the last one."""
    from stratalens.operators.hamming import _running_number

    numbered = _running_number(found.select("rel", walk_key(F.col("rel")).alias("key")), [F.col("key").asc(), F.col("rel").asc()]).select("rel", F.col("group_number").alias("accepted"))
    total = numbered.agg(F.max("accepted").alias("total"))  # one row
    return numbered.crossJoin(F.broadcast(total)).where((F.col("accepted") % every == 0) | (F.col("accepted") == F.col("total"))).select("accepted", "rel")


def stats_rows(stats: DataFrame) -> DataFrame:
    """(metric, value) of directory_stats(): files, bytes, and one row per media type."""
    fixed = F.array(F.struct(F.lit("files").alias("metric"), F.col("n_files").cast("string").alias("value")), F.struct(F.lit("total_bytes").alias("metric"), F.col("total_bytes").cast("string").alias("value")))
    types = F.transform(F.map_entries("counts_by_type"), lambda e: F.struct(e["key"].alias("metric"), e["value"].cast("string").alias("value")))
    return stats.select(F.explode(F.concat(fixed, types)).alias("r")).select("r.metric", "r.value")


def fnmatch_any(name: str, rel: str, patterns: list[str]) -> bool:
    """The driver-side twin of excluded() for one entry."""
    return any(fnmatch.fnmatch(name, p) or fnmatch.fnmatch(rel, p) for p in patterns)


def media_issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("message").agg(F.count("*").alias("n"))
