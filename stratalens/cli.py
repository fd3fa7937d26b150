"""Command line: stats, info, live-photos, clean, search, cache, config, init, doctor. Exit codes 0, 1 (error), 2 (usage), 130 (interrupt)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from stratalens import config as settings
from stratalens.errors import CacheError, EngineError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratalens")
    top.add_argument("--json", action="store_true", help="print JSON instead of a table")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("stats", "live-photos", "clean", "info"):
        sub.add_parser(name).add_argument("path")
    find = sub.add_parser("search")
    find.add_argument("store")
    find.add_argument("query")
    conf = sub.add_parser("config")
    conf.add_argument("action", choices=("show", "set", "reset", "validate"))
    conf.add_argument("file")
    conf.add_argument("key", nargs="?")
    conf.add_argument("value", nargs="?")
    kept = sub.add_parser("cache")
    kept.add_argument("action", choices=("show", "clear", "prune"))
    kept.add_argument("store")
    kept.add_argument("path", nargs="?", help="prune: the folder whose files keep their entries")
    sub.add_parser("init").add_argument("file")
    sub.add_parser("doctor")
    return top


def _session():
    from stratalens.session import local_session

    spark = local_session(4, "2g")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def live_photo_scan(spark, path: str) -> dict[str, list]:
    """All pairs, the stills and videos in none, and the files whose content was not read."""
    from pyspark.sql import functions as F

    from stratalens.functions.media_bytes import maker_note_tags
    from stratalens.functions.text import path_key
    from stratalens.operators import live_photos
    from stratalens.sources import files
    from stratalens.work import Workspace

    rows = files.regular_files(spark, path, content=True)
    ws = Workspace(spark, "live")  # the files are read once, not once per list
    tagged = ws.save(rows.select("path", "issue", maker_note_tags(F.col("content"))["Tag 0x0011"].alias("tag")), "tagged")
    found = live_photos.candidates(tagged, "path", "tag")
    paired = ws.save(live_photos.pairs(found), "pairs")
    loose = ws.save(live_photos.orphans(found, paired), "loose").orderBy(path_key(F.col("path")))
    return {
        "pairs": [r.asDict() for r in live_photos.scan_order(paired).toLocalIterator()],
        "unpaired_stills": [r.path for r in loose.where("kind = 'still'").toLocalIterator()],
        "unpaired_videos": [r.path for r in loose.where("kind = 'video'").toLocalIterator()],
        "issues": [r.asDict() for r in tagged.where("issue IS NOT NULL").select("path", "issue").orderBy(path_key(F.col("path"))).toLocalIterator()],
    }


def run(args: argparse.Namespace) -> object:
    if args.command == "config":
        path = Path(args.file)
        if args.action == "set":
            return settings.set_value(path, args.key, settings.env_value(args.value))
        if args.action == "reset":
            settings.write(path, {})
        return settings.load(path)
    if args.command == "init":
        return settings.initialise(Path(args.file))
    if args.command == "clean":
        from stratalens.operations import remove_empty_tree

        return {"removed": remove_empty_tree(args.path)}
    if args.command == "doctor":
        import shutil

        return {name: shutil.which(name) is not None for name in ("java", "ffprobe", "ffmpeg")}
    from pyspark.sql import functions as F

    from stratalens.operators import cache, inventory, report, search
    from stratalens.sources import files

    spark = _session()
    if args.command == "stats":
        return inventory.directory_stats(files.regular_files(spark, args.path), "media_type", "size", F.col("mtime")).first().asDict()
    if args.command == "cache":
        stored = cache.HashCache(spark, args.store)
        if args.action == "show":
            return stored.show()
        if args.action == "clear":
            return {"removed": stored.clear()}
        if not args.path:
            raise CacheError("prune needs the folder whose files keep their entries", operation="cache prune")
        return {"removed": stored.prune(files.regular_files(spark, args.path))}
    if args.command == "info":
        return files.inspect(spark, args.path).first().asDict(recursive=True)
    if args.command == "live-photos":
        return live_photo_scan(spark, args.path)
    store = report.ReportStore(spark, args.store)
    return [r.asDict() for r in search.ranked(store.table("media_files"), "id", ["path", "filename", "metadata"], args.query).toLocalIterator()]


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        result = run(args)
    except EngineError as error:
        print(json.dumps(error.as_dict()), file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    if args.json or not isinstance(result, dict):
        print(json.dumps(result, default=str, indent=2))
    else:
        for key, value in result.items():
            print(f"{key:24} {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
