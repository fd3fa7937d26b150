"""Configuration, security, file operations, events, command line and streams."""

import json
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens import cli, config, operations, pipeline, security
from stratalens.errors import ConfigError, FileOperationError, SecurityError
from stratalens.functions.text import clean_filename
from stratalens.schemas import domain_violations, json_schema, key_violations, missing_parents
from stratalens.streaming import latest


@pytest.mark.parametrize(("raw", "value"), [("true", True), (" True ", True), ("TRUE", "TRUE"), ("42", 42), ("1_000", 1000), ("1__000", "1__000"), ("0x10", 16), ("[1, 2]", [1, 2]), ("{a = 1}", {"a": 1}), ("'q'", "q"), ("plain text", "plain text"), ("@int 7", 7), ("@json [1]", [1]), ("@none x", None), ("@split a b", ["a", "b"]), ("@upper x", "X"), ("@nothing x", "@nothing x")])
def test_environment_values(raw, value):
    assert config.env_value(raw) == value


@pytest.mark.parametrize("raw", ["@format {x}", "@int @format x", "@int x", "@jinja y"])
def test_refused_values(raw):
    with pytest.raises(ConfigError):
        config.env_value(raw)


def test_config_layers(tmp_path):
    (tmp_path / "c.toml").write_text('workers = 2\nunknown = 1\n[paths]\nexclude_patterns = ["a"]\n')
    (tmp_path / "c.local.toml").write_text('[paths]\nexclude_patterns = ["b"]\n')
    got = config.load(tmp_path / "c.toml", {"STRATALENS_WORKERS": "3", "STRATALENS_ROUTING__MIN_CONFIDENCE": "0.5", "OTHER": "1"})
    assert (got["workers"], got["paths"]["exclude_patterns"], got["routing"]["min_confidence"]) == (3, ["a", "b"], 0.5)
    for bad in ({"STRATALENS_WORKERS": "0"}, {"STRATALENS_ROUTING__X": "1"}, {"STRATALENS_SYMLINK_POLICY": "maybe"}, {"STRATALENS_WORKERS": "x"}):
        with pytest.raises(ConfigError):
            config.load(None, bad)
    config.set_value(tmp_path / "n.json", "routing.review", "Later")
    assert json.loads((tmp_path / "n.json").read_text()) == {"routing": {"review": "Later"}}
    with pytest.raises(ConfigError):
        config.read_file(tmp_path.joinpath("x.ini").rename(tmp_path / "y.ini") if (tmp_path / "x.ini").exists() else _ini(tmp_path))


def _ini(folder):
    (folder / "z.ini").write_text("[a]\n")
    return folder / "z.ini"


@given(st.text(max_size=400))
def test_clean_filenames(name):
    safe = clean_filename(name)
    assert safe is None or (len(safe.encode()) <= 255 and not set(safe) & {"/", "\\", "\0"} and safe == safe.strip() and safe not in (".", "..") and clean_filename(safe) == safe)


def test_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("x")
    (tmp_path / "in" / "l").symlink_to(tmp_path / "in" / "f")
    assert security.validate(tmp_path / "in" / "f", [tmp_path / "in"]).name == "f"
    for bad in (tmp_path / "in" / ".." / "other", tmp_path / "in" / "l", "/etc/passwd", "a\0b"):
        with pytest.raises(SecurityError):
            security.validate(bad, [tmp_path / "in"])
    rows = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/a/../c",)], "p string")
    assert [r.x for r in rows.select(security.within(F.col("p"), ["/a"]).alias("x")).collect()] == [True, True, False, False]


def test_transactions(tmp_path):
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    with pytest.raises(FileOperationError), operations.FileTransaction() as t:
        t.move(tmp_path / "a", tmp_path / "x" / "y" / "a")
        t.copy(tmp_path / "b", tmp_path / "x" / "b")
        t.delete(tmp_path / "b")
        t.move(tmp_path / "missing", tmp_path / "z")
    assert sorted(p.name for p in tmp_path.rglob("*")) == ["a", "b"] and all(s.status == "rolled_back" for s in t.log)
    with operations.FileTransaction() as t:
        t.move(tmp_path / "a", tmp_path / "x" / "a")
        t.delete(tmp_path / "b")
    assert sorted(p.name for p in tmp_path.rglob("*")) == ["a", "x"] and t.log[-1].as_dict()["operation"] == "delete"
    (tmp_path / "e" / "f").mkdir(parents=True)
    assert operations.remove_empty_tree(tmp_path) == [str(tmp_path / "e" / "f"), str(tmp_path / "e")]
    copy = operations.backup(tmp_path / "x" / "a", tmp_path / "bak")
    (tmp_path / "x" / "a").write_text("changed")
    operations.restore(copy, tmp_path / "x" / "a")
    assert (tmp_path / "x" / "a").read_text() == "a"


def test_events_and_steps(spark):
    seen, context = [], pipeline.Context(spark)
    context.bus.subscribe(lambda e: seen.append(("any", e.step)))
    context.bus.subscribe(lambda e: seen.append(("start", e.step)), pipeline.StepStarted)
    context.bus.subscribe(lambda e: 1 / 0, pipeline.StepCompleted)
    listing = spark.createDataFrame([("a.jpg", False, False, "image"), ("l.jpg", False, True, "image")], "rel string, is_dir boolean, is_symlink boolean, media_type string")
    tables, took = pipeline.run({"discovery": pipeline.discovery}, {"listing": listing}, context)
    assert tables["files"].count() == 1 and list(took) == ["discovery"] and seen[:2] == [("start", "discovery"), ("any", "discovery")] and len(context.bus.errors) == 1
    with pytest.raises(Exception, match="no service"):
        context.require("hasher")


def test_cli(tmp_path, capsys):
    assert cli.main(["nonsense"]) == 2
    assert cli.main(["config", "set", str(tmp_path / "c.json"), "workers", "4"]) == 0
    assert cli.main(["--json", "config", "show", str(tmp_path / "c.json")]) == 0 and '"workers": 4' in capsys.readouterr().out
    assert cli.main(["config", "set", str(tmp_path / "c.json"), "workers", "no"]) == 1
    assert cli.main(["doctor"]) == 0
    assert cli.main(["init", str(tmp_path / "new.json")]) == 0 and cli.main(["init", str(tmp_path / "new.json")]) == 1
    assert cli.main(["cache", "eat", "x"]) == 2


def test_schema_checks(spark):
    runs = spark.createDataFrame([(1, "completed"), (1, "odd"), (2, None)], "id long, status string")
    assert domain_violations(runs, "report_runs").count() == 2 and key_violations(runs, "id").count() == 1
    assert missing_parents(spark.createDataFrame([(1,), (9,), (None,)], "id long"), runs, ["id"]).count() == 1
    assert "fields" in json_schema("media_files")


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(r, "id long, at string").withColumn("at", F.to_timestamp("at"))
    rows((1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")).write.parquet(source)
    latest.drain(latest.deduplicated(latest.stream(spark, source), ["id"], "at"), out, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    rows((2, "2024-01-01 03:00:00"), (3, "2024-01-01 04:00:00")).write.mode("append").parquet(source)
    latest.drain(latest.deduplicated(latest.stream(spark, source), ["id"], "at"), out, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    latest.drain(latest.windowed_counts(latest.stream(spark, source), "at", ["id"], "1 day", "0 seconds"), str(tmp_path / "w"), str(tmp_path / "cw")).awaitTermination()
    assert latest.hash_misses(spark.read.parquet(source), rows((1, None)).withColumnRenamed("id", "path"), "id").count() == 3 and os.path.exists(out)


def test_migrations(tmp_path):
    from stratalens import migrations
    from stratalens.errors import ReportError

    done = []
    step = lambda n: (n, lambda root: done.append(n))
    assert migrations.version(tmp_path) == 0
    assert migrations.apply(tmp_path, 2, lambda root: done.append("base"), [step(2)], "now") == [2] and migrations.version(tmp_path) == 2
    assert migrations.apply(tmp_path, 4, lambda root: None, [step(2), step(3), step(4)], "now") == [3, 4] and done == ["base", 3, 4]
    assert migrations.apply(tmp_path, 4, lambda root: None, [step(4)], "now") == [] and migrations.missing(tmp_path) == []
    for target, steps in ((3, [step(3)]), (6, [step(5)]), (6, [step(5), step(7)])):
        with pytest.raises(ReportError):
            migrations.apply(tmp_path, target, lambda root: None, steps, "now")


def test_cli_lists_everything(spark, tmp_path, monkeypatch):
    from stratalens.operators import report
    from stratalens.sources import files

    monkeypatch.setattr(cli, "_session", lambda: spark)
    monkeypatch.setattr(files, "MAX_CONTENT", 3)
    folder = tmp_path / "library"
    folder.mkdir()
    for n in range(1001):
        (folder / f"i{n}.jpg").write_bytes(b"x")
        (folder / f"i{n}.mov").write_bytes(b"x")
    (folder / "lone.jpg").write_bytes(b"x")
    (folder / "lone-too.mov").write_bytes(b"long")
    got = cli.run(cli.parser().parse_args(["live-photos", str(folder)]))
    assert len({(p["still"], p["video"]) for p in got["pairs"]}) == 1001
    assert (got["unpaired_stills"], got["unpaired_videos"], [i["path"] for i in got["issues"]]) == ([str(folder / "lone.jpg")], [str(folder / "lone-too.mov")], [str(folder / "lone-too.mov")])
    rows = spark.range(101).select(F.format_string("/l/rusty %d.jpg", "id").alias("path"), F.lit("image").alias("media_type"), F.lit(1).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("metadata"))
    none = spark.createDataFrame([], "group_number int, media_type string, path string, target_path string")
    ops = spark.createDataFrame([], "operation string, status string, source string, destination string")
    report.ReportStore(spark, str(tmp_path / "store")).export(report.RunExport("/l", rows, none, ops))
    assert len(cli.run(cli.parser().parse_args(["search", str(tmp_path / "store"), "rusty"]))) == 101


def test_every_discovery_issue_is_published(spark):
    seen, context = [], pipeline.Context(spark)
    context.bus.subscribe(lambda e: seen.append(e.path), pipeline.StepIssue)
    listing = spark.range(101).select(F.format_string("l%d.jpg", "id").alias("rel"), F.lit(False).alias("is_dir"), F.lit(True).alias("is_symlink"), F.lit("image").alias("media_type"))
    pipeline.discovery({"listing": listing}, context)
    assert sorted(seen) == sorted(f"l{n}.jpg" for n in range(101))


@pytest.mark.parametrize(("text", "value"), [("@bool y", False), ("@bool YES", True), ("@bool whatever", False), ('@json {"a": 1}', {"a": 1}), ("@json see {'b': 2} and {\"a\": True}", {"a": True}), ("@json (1, 2)", (1, 2)), ("@int 4", 4), ("plain", "plain")])
def test_casts(text, value):
    from stratalens.config import cast

    assert cast(text) == value


def test_casts_that_fail():
    from stratalens.config import cast
    from stratalens.errors import ConfigError

    for text in ("@json {", "@int x", "@format x"):
        with pytest.raises(ConfigError):
            cast(text)


def test_commands_round_trip_and_run_once(tmp_path):
    from stratalens.errors import FileOperationError
    from stratalens.operations import Command

    a, b = tmp_path / "a", tmp_path / "deep" / "b"
    a.write_text("x")
    for kind, source, destination in (("move_file", a, b), ("copy_file", a, b), ("delete_file", a, None), ("create_directory", None, tmp_path / "new" / "er")):
        command = Command.from_dict(json.loads(json.dumps(Command(kind, source and str(source), destination and str(destination)).as_dict())))
        with pytest.raises(FileOperationError):
            command.undo()
        command.execute()
        again = Command.from_dict(json.loads(json.dumps(command.as_dict())))
        with pytest.raises(FileOperationError):
            again.execute()
        assert a.exists() == (kind in ("copy_file", "create_directory")) and b.exists() == (kind in ("move_file", "copy_file")) and (tmp_path / "new" / "er").exists() == (kind == "create_directory")
        again.undo()
        assert again.status == "undone" and sorted(p.name for p in tmp_path.iterdir()) == ["a"]
    gone = Command("delete_file", str(a))
    gone.execute()
    gone.discard()
    assert list(tmp_path.iterdir()) == [] and gone.status == "final"
    failing = Command("move_file", str(a), str(b))
    with pytest.raises(FileOperationError):
        failing.execute()
    assert failing.status == "failed" and not b.parent.exists()
    for bad in (("eat", "x", "y"), ("move_file", "x", None), ("delete_file", None, None)):
        with pytest.raises(FileOperationError):
            Command(*bad)
