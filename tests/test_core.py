"""The engine's own operators on small inputs, against brute force where there is one."""

import random
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.errors import DuplicateError, HashError, PipelineError, ReportError, SecurityError
from stratalens.functions import dates, hashing, images, media_bytes, numbers, text
from stratalens.operators import cache, classify, hamming, inventory, live_photos, orphans, quality, report, saga, search
from stratalens.sources import files as files_source
from stratalens.sources import probes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "bits"), [("ff", 8), ("0x0F", 8), (" phash:8:8000000000000000 ", 64), ("dhash:2:f", 4)])
def test_digests(spark, value, bits):
    d = one(spark, hashing.digest_parts(F.lit(value)))
    assert d["error"] is None and d["bits"] == bits


@pytest.mark.parametrize("value", ["", "xyz", "0x", "phash:8:ff", "sha1:2:f", "phash:8:", "a:b"])
def test_bad_digests(spark, value):
    assert one(spark, hashing.digest_parts(F.lit(value)))["error"]


def test_distance(spark):
    part = lambda s: hashing.digest_parts(F.lit(s))
    assert one(spark, hashing.digest_distance(part("ff00"), part("ff01")))["distance"] == 1
    assert one(spark, hashing.digest_distance(part("ff"), part("ff01")))["error"] == "widths differ"
    assert one(spark, hashing.digest_distance(part("ahash:2:f"), part("phash:2:f")))["error"] == "algorithms differ"
    assert one(spark, hashing.similarity(F.lit(1), F.lit(16))) == 1 - 1 / 16
    with pytest.raises(HashError):
        hashing.cache_algorithm("whash", 6)
    assert hashing.cache_algorithm("phash") == "phash:8" and hashing.cache_algorithm("sha256") == "content-sha256"


def groups(spark, rows, threshold, **kw):
    df = spark.createDataFrame(rows, "ord long, path string, h string, kind string")
    got = hamming.duplicate_groups(df, "path", "h", "kind", "ord", threshold, **kw).collect()
    out = {}
    for r in got:
        out.setdefault(r.group_number, set()).add(r.path)
    return out


def test_groups(spark):
    rows = [(0, "/a", "f0", "image"), (1, "/b", "f1", "image"), (2, "/c", "f3", "image"), (3, "/d", "f0", "video"), (4, "/x/e", "0000", "image"), (5, "/x-f", "0000", "image")]
    assert groups(spark, rows, 1) == {1: {"/a", "/b", "/c"}, 2: {"/x/e", "/x-f"}}
    assert groups(spark, rows[:4], 64) == {1: {"/a", "/b", "/c"}}
    with pytest.raises(DuplicateError):
        groups(spark, [*rows, (9, "/a", "ff", "image")], 1)
    with pytest.raises(DuplicateError):
        groups(spark, [(0, "/a", "xyz", "image")], 1)
    with pytest.raises(DuplicateError):
        groups(spark, rows, -1)


def test_banded_join_equals_brute_force(spark):
    rnd = random.Random(99)
    base = rnd.getrandbits(64)
    values = {base}
    while len(values) < 50:
        x = base
        for b in rnd.sample(range(64), rnd.randrange(13)):
            x ^= 1 << b
        values.add(x)
    rows = [(i, f"/{i}", f"{v:016x}", "image") for i, v in enumerate(sorted(values))]
    df = spark.createDataFrame(rows, "ord long, path string, h string, kind string")
    got = {(r.ord_a, r.ord_b): r.distance for r in hamming.near_edges(hamming.representatives(hamming.parsed(df, "path", "h", "kind", "ord")), 8).collect()}
    v = sorted(values)
    assert got == {(i, j): d for i in range(len(v)) for j in range(i + 1, len(v)) if (d := (v[i] ^ v[j]).bit_count()) <= 8}


def test_quality(spark):
    df = spark.createDataFrame([(1, "/low", 100, 100, 1000, None), (1, "/high", 1000, 1000, 50000, None), (1, "/none", None, None, 0, None)], "g int, path string, w long, h long, size long, rate long")
    rows = df.select("g", "path", *quality.metrics(F.col("w"), F.col("h"), F.col("size"), F.col("rate"), F.lit("image")))
    got = {r.path: (r["rank"], r.composite) for r in quality.ranked(rows, ["g"], "path").collect()}
    assert got["/high"] == (1, 0.5) and got["/low"][0] == 2 and got["/none"] == (3, 0.0)
    with pytest.raises(DuplicateError):
        quality.Weights(0, 0, 0, 0)
    with pytest.raises(DuplicateError):
        quality.require_members(df.select("path"), df.limit(0).select("path"), ["path"])


def test_cache(spark):
    stored = spark.createDataFrame([("/a", "x", 1.0, 5, "good"), ("/b", "x", 1.0, 5, "bad"), ("/c", "x", 1.0, 5, "good")], "path string, algorithm string, mtime double, size long, hash string")
    wanted = spark.createDataFrame([("/a", "x", 1.0, 5), ("/b", "x", 1.0, 5), ("/c", "x", 2.0, 5), ("/a", "y", 1.0, 5)], "path string, algorithm string, mtime double, size long")
    looked = cache.lookup(wanted, stored, F.col("hash") == "good")
    assert [(r.path, r.algorithm) for r in looked.where("hit").collect()] == [("/a", "x")]
    up = cache.upsert(stored, spark.createDataFrame([("/c", "x", 2.0, 5, "old", 1), ("/c", "x", 2.0, 5, "new", 2)], "path string, algorithm string, mtime double, size long, hash string, ord long"))
    assert {r.path: r.hash for r in up.collect()} == {"/a": "good", "/b": "bad", "/c": "new"}
    assert cache.stale(stored, wanted.where("path = '/a'")).count() == 2
    files = spark.createDataFrame([(0, "/a", "image", 1.0, 5, "t"), (1, "/n", "image", 1.0, 5, None), (2, "/v", "video", 1.0, 5, "t")], "ord long, path string, media_type string, mtime double, size long, content string")
    outcome, fresh = cache.batch(files, {"image": "x"}, stored, lambda c: F.md5(c), F.col("hash") == "good")
    assert {r.path: r.status for r in outcome.collect()} == {"/a": "cached", "/n": "failed", "/v": "skipped"} and fresh.count() == 0


def test_inventory(spark):
    rows = [("b.jpg", False, False, 5, 1.0, "image"), (".x/c.jpg", False, False, 5, 1.0, "image"), ("a/d.jpg", False, False, 7, 2.0, "image"), ("a/z/e.mov", False, False, 7, 2.0, "video"), ("notes.txt", False, False, 7, 2.0, None), ("skip/k.jpg", False, False, 7, 2.0, "image"), ("l.jpg", False, True, 7, 2.0, "image")]
    df = spark.createDataFrame(rows, "rel string, is_dir boolean, is_symlink boolean, size long, mtime double, media_type string")
    media, issues = inventory.discover(df, ["sk*"])
    assert [r.rel for r in media.collect()] == ["b.jpg", "a/d.jpg", "a/z/e.mov"] and [r.rel for r in issues.collect()] == ["l.jpg"]
    assert [r.rel for r in inventory.discover(df, None, 1)[0].collect()] == ["b.jpg", "a/d.jpg", "skip/k.jpg"]
    stats = inventory.directory_stats(df, "media_type", "size", F.col("mtime")).first()
    assert (stats.n_files, stats.n_unknown, stats.counts_by_type) == (7, 1, {"image": 5, "video": 1})
    assert inventory.directory_stats(df.limit(0), "media_type", "size", F.col("mtime")).first().n_files == 0
    dirs = spark.createDataFrame([("first", False), ("first/a", False), ("first/z", False), ("first/z/leaf", False), ("second", True), ("keep", False), ("keep/x", False)], "rel string, has_files boolean").withColumn("is_symlink", F.lit(False))
    assert [r.rel for r in inventory.empty_directories(dirs, ["x"]).collect()] == ["first/a", "first/z/leaf", "first/z", "first"]


def test_classification(spark):
    shot = lambda *a: one(spark, classify.screenshot(*[F.lit(x) for x in a]))
    assert shot("Screen Shot 1.png", None, 0, 0)["confidence"] == 0.6 and shot(None, "Greenshot 1.2", 1920, 1080)["confidence"] == 1.0
    assert not shot("x.png", None, 1920, 1080)["is_screenshot"] and not shot("x.png", None, 640, 480)["by_size"]
    pg = lambda *a: one(spark, classify.photo_graphic(*[F.lit(x) for x in a]))
    assert pg(True, True, None)["content_type"] == "photo" and pg(False, False, None)["content_type"] == "unknown" and pg(False, True, None)["confidence"] == 1.0
    struct_ = lambda name, flag, conf: F.struct(F.lit(flag).alias(name), F.lit(conf).alias("confidence"))
    route = lambda live, ai, sh, gr: one(spark, classify.route(F.lit(live), struct_("is_ai_generated", *ai), struct_("is_screenshot", *sh), struct_("content_type", *gr)))
    no, plain = (False, 0.0), ("photo", 1.0)
    assert route(True, (True, 1.0), no, plain) == "live_photo" and route(False, (True, 0.8), no, plain) == "ai_generated"
    assert route(False, no, (True, 0.6), plain) == "review" and route(False, no, (True, 0.6), ("graphic", 0.8)) == "graphic" and route(False, no, no, plain) is None
    assert one(spark, classify.generator_marker(F.lit("Made by ComfyUI and Midjourney"))) == "comfyui"
    with pytest.raises(ValueError):
        classify.Routing(folders={"a": "X", "b": "x"})


def test_live_photos(spark):
    rows = [("/a.jpg", "i"), ("/b.jpg", "i"), ("/c.jpg", "i"), ("/b.mov", "i"), ("/z.mov", "i"), ("/q/s.JPG", None), ("/q/S.mov", "k"), ("/t.heic", "x"), ("/t.mov", "y"), ("/n.txt", "i")]
    found = live_photos.candidates(spark.createDataFrame(rows, "path string, tag string"), "path", "tag")
    made = live_photos.pairs(found)
    got = {(r.still, r.video, r.verified) for r in made.collect()}
    assert got == {("/b.jpg", "/b.mov", True), ("/a.jpg", "/z.mov", True), ("/q/s.JPG", "/q/S.mov", False)}
    assert {r.path for r in live_photos.orphans(found, made).collect()} == {"/c.jpg", "/t.heic", "/t.mov"}


def test_report_store(spark, tmp_path):
    files = spark.createDataFrame([("/l/a.jpg", "image", 5, 0.5), ("/l/b.jpg", "image", 6, None), ("/l/c.mov", "video", 7, None)], "path string, media_type string, size_bytes long, quality_score double")
    groups_ = spark.createDataFrame([(1, "image", "/l/a.jpg", "/l/b.jpg"), (1, "image", "/l/b.jpg", "/l/b.jpg")], "group_number int, media_type string, path string, target_path string")
    ops = spark.createDataFrame([("move", "applied", "/l/a.jpg", "/o/a.jpg"), ("mkdir", "applied", None, "/o")], "operation string, status string, source string, destination string")
    store = report.ReportStore(spark, str(tmp_path / "r"))
    run = store.export(report.RunExport("/l", files, groups_, ops, notes="n"))
    assert store.export(report.RunExport("/l", files, groups_, ops), run) == run and store.list_runs().count() == 1
    media = {r.path: r for r in store.list_media_files(run).collect()}
    group = store.list_groups(run).first()
    assert media["/l/a.jpg"].group_id == group.id and group.best_file_id == media["/l/b.jpg"].id and group.file_count == 2 and media["/l/c.mov"].group_id is None
    assert {r.operation: r.media_file_id for r in store.list_operations(run).collect()} == {"move": media["/l/a.jpg"].id, "mkdir": None}
    totals = store.list_runs().first()
    assert (totals.total_files, totals.duplicate_count, totals.status) == (3, 2, "completed")
    store.update_run(run, "running", 9)
    assert (store.list_runs().first().total_files, store.list_runs().first().completed_at) == (9, None)
    store.delete_group(run, 1)
    assert store.list_groups(run).count() == 0 and store.list_media_files(run).where("group_id is not null").count() == 0
    with pytest.raises(ReportError):
        store.export(report.RunExport("/l", files.unionByName(files), groups_, ops))
    with pytest.raises(ReportError):
        store.export(report.RunExport("/l", files, groups_, ops), 77)
    store.delete_run(run)
    assert store.list_runs().count() == 0


def test_search_against_sqlite(spark):
    rnd = random.Random(4)
    words = "café harbor IMG_0001 rusty tractor, Ünder-score the".split()
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 30))), " ".join(rnd.choices(words, k=rnd.randrange(4)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b)")
    db.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id long, a string, b string")
    for query in ("cafe harbor", "rusty tractor the", "img 0001", "IMG_0001", "nothing", ""):
        match = " ".join(f'"{t}"' for t in query.split())
        want = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))) if match else {}
        got = {r.doc: r.score for r in search.search(df, "id", ["a", "b"], query).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_search_index_equals_search(spark, tmp_path):
    rows = [(1, "Łódź Ελλάδα harbor harbor", "x"), (2, "lodz harbor", "harbor boat"), (3, None, None), (4, "boat harbor, BOAT Harbor", "Đak ảbc ǧak"), (5, "ΕΛΛΆΔΑ abc", "")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    index = search.SearchIndex(spark, f"file:{tmp_path}/index").build(df, "id", ["a", "b"])
    found = {}
    for query in ("harbor", '"boat harbor"', "harbor boat", "Łódź", "łodz", "ελλαδα", "Ảbc", "ǧak đak", "abc", "none", ""):
        want = {r.doc: r.score for r in search.search(df, "id", ["a", "b"], query).collect()}
        got = {r.doc: r.score for r in index.search(query).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), query
        found[query] = set(got)
    assert found["Łódź"] == found["łodz"] == {1} and found["ελλαδα"] == {1, 5} and found["Ảbc"] == {4, 5} and found["ǧak đak"] == {4} and found["abc"] == {4, 5}
    assert search.SearchIndex(spark, f"file:{tmp_path}/none").build(df.limit(0), "id", ["a"]).search("x").count() == 0


def test_raw_search_expressions_against_sqlite(spark):
    rows = [(1, "red harbor", "x one"), (2, "red boat", "harbor"), (3, "blue boats", ""), (4, None, "red red")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b)")
    db.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id long, a string, b string")
    for raw in ("red", "red AND harbor", "red NOT harbor", "blue OR one", "boat*", "a:harbor", '"red harbor" OR boats', "(red OR blue) NOT boat", "red harbor"):
        assert {r.doc for r in search.matches(df, "id", ["a", "b"], raw).collect()} == {i for (i,) in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (raw,))}, raw
    for bad in ('"open', "(red", "red AND", "c:red", "red)", "a^b"):
        with pytest.raises(ReportError):
            search.matches(df, "id", ["a", "b"], bad)
    assert search.matches(df, "id", ["a"], " ").count() == 0


def test_hasher_of_the_configuration(spark):
    digest = lambda config: one(spark, hashing.hasher_from_config(config)(F.lit("x")))
    assert digest({}).startswith("sha256:") and digest({"hash_algorithm": "MD5"}).startswith("md5:")
    for name in ("phash", "crc"):
        with pytest.raises(HashError):
            hashing.hasher_from_config({"hash_algorithm": name})
    part = lambda t: hashing.digest_parts(F.lit(t))
    assert one(spark, hashing.is_similar(part("phash:2:f"), part("phash:2:e"), 1)) is True
    assert one(spark, hashing.is_similar(part("phash:2:f"), part("phash:2:e"), 0)) is False
    assert one(spark, hashing.is_similar(part("phash:2:f"), part("ahash:2:f"), 9)) is None
    with pytest.raises(HashError):
        hashing.is_similar(part("f"), part("f"), -1)


def test_hash_cache_store(spark, tmp_path):
    kept = cache.HashCache(spark, f"file:{tmp_path}/cache")
    assert kept.show() == {"entries": 0, "paths": 0, "stored_bytes": 0} and kept.clear() == 0
    entry = "path string, algorithm string, mtime double, size long, hash string, ord long"
    kept.write(spark.createDataFrame([("/a", "x", 1.0, 5, "old", 1), ("/b", "x", 1.0, 5, "h", 2)], entry))
    kept.write(spark.createDataFrame([("/a", "x", 2.0, 5, "new", 1)], entry))
    assert {(r.path, r.hash) for r in kept.read().collect()} == {("/a", "new"), ("/b", "h")} and kept.show()["stored_bytes"] > 0
    listing = spark.createDataFrame([("/a",)], "path string")
    assert kept.prune(listing) == 1 and kept.prune(listing) == 0 and kept.clear() == 1 and kept.read().count() == 0


def test_saga_log(spark, tmp_path):
    log = saga.SagaLog(spark, f"file:{tmp_path}/log")
    assert log.sessions().count() == log.commands().count() == 0
    one = log.create_session("/in", "/out", "abc", "feedbeef00")
    assert one.endswith("-feedbeef")
    first, second = log.append_command(one, "move_file", {"b": 1, "a": "/x"}), log.append_command(one, "copy_file", {})
    assert (first, second) == (1, 2)
    log.mark_done(first, {"z": 1, "y": None})
    with pytest.raises(PipelineError):
        log.mark_done(first)
    log.mark_command(second, "failed")
    log.compact()
    log.finish_session(one)
    two = log.create_session("/in", "/out", "abc")
    assert log.mark_interrupted() == 1
    rows = {r.seq: r for r in log.commands().collect()}
    assert (rows[1].status, rows[1].args_json, rows[1].log_json, rows[1].session_id) == ("done", '{"a": "/x", "b": 1, "schema": 1}', '{"y": null, "z": 1}', one)
    assert (rows[2].status, rows[2].command_type, rows[2].log_json) == ("failed", "copy_file", None) and rows[1].completed_at
    assert {r.session_id: (r.status, r.source, r.completed_at is None) for r in log.sessions().collect()} == {one: ("completed", "/in", False), two: ("interrupted", "/in", False)}
    for bad in (lambda: log.append_command(one, "x", {}), lambda: log.append_command("none", "x", {}), lambda: log.mark_command(9, "done"), lambda: log.mark_command(1, "odd"), lambda: log.finish_session(two, "running")):
        with pytest.raises(PipelineError):
            bad()


def test_single_rows_of_the_store(spark, tmp_path):
    store = report.ReportStore(spark, f"file:{tmp_path}/store")
    run = store.create_run("/library", notes="n")
    a, b = store.add_media_file(run, "/library/a.jpg", "image", 5, quality_score=0.5), store.add_media_file(run, "/library/b.jpg", "image", 6)
    group = store.add_duplicate_group(run, 3, "image", 2, best_file_id=a)
    op = store.add_operation(run, "move", "applied", "/library/b.jpg", "/else/b.jpg")
    assert (a, b, group, op) == (1, 2, 1, 1)
    assert [(r.id, r.filename, r.quality_score) for r in store.list_media_files(run).collect()] == [(1, "a.jpg", 0.5), (2, "b.jpg", None)]
    assert store.list_operations(run).first().media_file_id == b and store.list_groups(run).first().best_file_id == a
    assert store.assign_group(run, a, 3) == 1 and store.assign_group(run, 99, 3) == 0 and store.delete_group(run, 3) == 1 and store.delete_group(run, 3) == 0
    for bad in (lambda: store.add_media_file(run, "/library/a.jpg", "image", 1), lambda: store.add_media_file(run, "/c", "poem", 1), lambda: store.add_operation(run, "eat", "applied"), lambda: store.add_media_file(9, "/c", "image", 1), lambda: store.create_run("/x", "odd"), lambda: store.add_media_file(run, "/c", "image", 1, odd=1)):
        with pytest.raises(ReportError):
            bad()
    version = store.version()
    store.create_run("/other")
    with pytest.raises(ReportError):
        store._publish({}, version)  # another writer was faster
    assert store.list_runs().count() == 2 and store.delete_run(run) and not store.delete_run(run) and store.list_runs().count() == 1


def test_saga(spark):
    sessions = spark.createDataFrame([("a", "2024", "2025", "completed"), ("b", "2023", None, "running"), ("c", "2022", "2023", "failed")], "session_id string, started_at string, completed_at string, status string")
    commands = spark.createDataFrame([(1, "a", "done"), (2, "a", "done"), (3, "c", "done")], "seq long, session_id string, status string")
    assert {r.session_id: r.command_count for r in saga.with_command_counts(sessions, commands).collect()} == {"a": 2, "b": 0, "c": 1}
    assert saga.interrupted(saga.mark_interrupted(sessions)).first().n == 1 and saga.latest_completed(sessions).first().session_id == "a"
    left, rest = saga.delete_sessions(sessions, commands, saga.deletable(sessions, "2023"))
    assert left.count() == 2 and rest.count() == 2 and [r.seq for r in saga.pending_undo(commands).collect()] == [3, 2, 1]
    events = spark.createDataFrame([("a", 1, "x", "p"), ("a", 2, "y", None)], "k string, n long, status string, note string")
    state = saga.latest_state(events, ["k"], "n", ["status", "note"]).first()
    assert (state.status, state.note) == ("y", "p")


def test_orphans(spark):
    day = lambda d, h=0: f"2024-01-{d:02} {h:02}:00:00"
    refs = [(1, "p1", day(2)), (2, "gone", day(2)), (3, "dead", day(2)), (4, "late", day(2)), (5, "soon", day(2)), (6, None, day(2)), (7, "edge", day(2)), (8, "p1", None), (1, "p1", day(1)), *[(100 + i, "hot", day(3)) for i in range(50)]]
    owners = [("p1", day(1), None), ("dead", day(1), day(5)), ("late", day(4), None), ("soon", day(2, 23), None), ("edge", day(3), None), ("p1", day(9), None)]
    r = spark.createDataFrame(refs, "id long, k string, at string").withColumn("at", F.to_timestamp("at"))
    o = spark.createDataFrame(owners, "k string, at string, dead string").withColumn("at", F.to_timestamp("at")).withColumn("dead", F.to_timestamp("dead"))
    run = lambda a, b: orphans.orphans(orphans.references(a, "f", "id", F.col("k"), "at"), orphans.parents(b, "f", F.col("k"), "at", "dead"))
    got = {x.row_id: x.reason for x in run(r, o).collect()}
    assert got == {2: "missing", 3: "deleted", 4: "late"} | {100 + i: "missing" for i in range(50)}
    assert run(r.limit(0), o).count() == 0 and run(r, o.limit(0)).count() == 57


def test_packed_bitmaps():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 100, 5000, 32768):
        bits = rnd.choice(1 << 15, n, replace=False)
        assert set(np.flatnonzero(orphans.unpack(orphans.pack(bits)))) == set(bits.tolist()) and len(orphans.pack(bits)) <= 4097


def test_text_functions(spark):
    for value, want in {"A/b.JPG": "jpg", "jpg": "jpg", ".jpg": "jpg", "dir/name": "", "c:\\x\\y.TiFF ": "tiff", "a.b/c": ""}.items():
        assert one(spark, text.normalize_extension(F.lit(value))) == want
    for size, want in {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1280: "1.2 KiB", 1 << 50: "1.0 PiB", 1 << 61: "2048.0 PiB"}.items():
        assert one(spark, text.format_size(F.lit(size))) == want
    assert text.sanitize_filename(" a/b\0c.. ") == "a_b_c" and len(text.sanitize_filename("é" * 300).encode()) <= 255
    assert one(spark, text.sanitized(F.lit("x/y"))) == "x_y"
    with pytest.raises(SecurityError):
        text.sanitize_filename("...")
    assert one(spark, text.media_type(F.lit("nef"))) == "image" and one(spark, text.sniff(F.lit(bytearray(b"\x89PNG\r\n\x1a\n....")))) == "image"
    assert one(spark, text.plan_directory(F.lit("X"), F.lit("2024/05"), F.lit(False))) == "X"


def test_numbers_and_dates(spark):
    assert one(spark, numbers.non_negative_int(F.lit("12.5"), True)) == 12 and one(spark, numbers.non_negative_int(F.lit("-1"))) is None
    assert one(spark, numbers.frame_rate(F.lit("30000/1001"))) == 30000 / 1001 and one(spark, numbers.frame_rate(F.lit("1/0"))) is None
    assert one(spark, numbers.non_negative_float(F.lit("nan"))) is None and one(spark, numbers.first_available(F.lit("N/A"), F.lit("x"))) == "x"
    assert str(one(spark, dates.exif_datetime(F.lit("2024:3:1 1:2:3\0")))) == "2024-03-01 01:02:03" and one(spark, dates.exif_datetime(F.lit("0000:00:00 00:00:00"))) is None
    assert one(spark, dates.iso_datetime(F.lit("2024-03-01T01:02:03Z")))["has_offset"] and not one(spark, dates.iso_datetime(F.lit("2024-03-01T01:02:03")))["has_offset"]
    assert one(spark, dates.log_time(F.timestamp_micros(F.lit(1)))) == "1970-01-01T00:00:00.000001+00:00"


def png(pixels: np.ndarray, chunks: list[tuple[bytes, bytes]] = ()) -> bytes:
    height, width = pixels.shape[:2]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return media_bytes.PNG_MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + b"".join(part(*c) for c in chunks) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    rnd = np.random.default_rng(3)
    smooth = np.clip(np.add.outer(np.arange(64), np.arange(64))[..., None] + np.array([0, 20, 40]), 0, 255).astype(np.uint8)
    near, far = smooth.copy(), rnd.integers(0, 255, (64, 64, 3)).astype(np.uint8)
    near[5:8, 5:8] = 0
    flat = np.full((64, 64, 3), 7, np.uint8)
    for name, p in {"a": smooth, "b": near, "c": far, "d": flat}.items():
        (tmp_path / f"{name}.png").write_bytes(png(p, [(b"tEXt", b"parameters\0a prompt"), (b"caBX", b"jumb c2pa trainedAlgorithmicMedia")]))
    (tmp_path / "x.png").write_bytes(b"no picture")
    shot = files_source.images(spark, str(tmp_path))
    rows = shot.select(F.substring_index("image.origin", "/", -1).alias("n"), *[images.perceptual_hash(F.col("image"), a).alias(a) for a in hashing.PERCEPTUAL], images.sharpness(F.col("image")).alias("s"), images.palette(F.col("image")).alias("p"))
    got = {r.n: r for r in rows.collect()}
    assert got["d.png"].p.distinct_colors == 1 and got["d.png"].p.dominant_pixel_ratio == 1.0 and got["d.png"].s == 0 < got["c.png"].s
    for algorithm in hashing.PERCEPTUAL:
        value = lambda n, a=algorithm: int(got[n][a].split(":")[2], 16)
        assert (value("a.png") ^ value("b.png")).bit_count() < (value("a.png") ^ value("c.png")).bit_count()
    meta = files_source.with_image_metadata(files_source.regular_files(spark, str(tmp_path), content=True)).where("path like '%/a.png'").first()
    assert (meta.header.width, meta.header.image_format, meta.header.color_mode, meta.chunks) == (64, "PNG", "RGB", {"parameters": "a prompt"})
    assert one(spark, classify.c2pa_ai_source(F.lit(meta.c2pa)))


def test_exif_and_maker_notes():
    note = b"Apple iOS\0\0\1MM" + struct.pack(">H", 1) + struct.pack(">HHII", 0x11, 2, 5, 12 + 2 + 2 + 12) + b"uuid\0"
    entries = [(0x010F, 2, b"Apple\0"), (0x0132, 2, b"2024:03:01 01:02:03\0"), (0x927C, 7, note)]
    body, data = b"", b""
    start = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, value in entries:
        body += struct.pack(">HHII", tag, kind, len(value), start + len(data))
        data += value
    tiff = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", len(entries)) + body + b"\0" * 4 + data
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
    assert media_bytes.exif(jpeg) == {"Make": "Apple", "DateTime": "2024:03:01 01:02:03"} and media_bytes.apple_maker_note(jpeg) == {"Tag 0x0011": "uuid"}
    for junk in (b"", b"\xff\xd8\xff", b"\xff\xd8\xff\xe1\0\x10Exif\0\0MM\0*", media_bytes.PNG_MAGIC, tiff[:30]):
        assert media_bytes.exif(junk) in ({}, {"Make": "Apple"}) and media_bytes.header(junk) is None and media_bytes.c2pa(junk) is None and media_bytes.text_chunks(junk) == {}


def test_probes(spark):
    payload = '{"streams":[{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"bit_rate":"N/A","avg_frame_rate":"30000/1001","tags":{}},{"codec_type":"audio","codec_name":"mp3","sample_rate":"44100","channels":2}],"format":{"duration":"4.5","bit_rate":"800000","tags":{"Creation_Time":"x"}}}'
    v = one(spark, probes.video_metadata(F.lit(payload)))
    assert (v.width, v.duration_seconds, v.bitrate, v.sample_rate, v.codec) == (1920, 4.5, 800000, 44100, "h264")
    assert one(spark, probes.audio_metadata(F.lit(payload))).codec == "MP3" and one(spark, probes.container_tags(F.lit(payload))) == {"creation_time": "x"} and one(spark, probes.container_tags(F.lit("no"))) == {}
    assert one(spark, probes.audio_tags(F.create_map(F.lit("Date"), F.array(F.lit("1"), F.lit("2"))))) == {"year": "1, 2"}
    assert probes.probe(spark.createDataFrame([("/x",)], "path string"), program="no-such-program").first().payload is None


def test_walk(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jpg").write_bytes(b"x")
    (tmp_path / "l.jpg").symlink_to(tmp_path / "d" / "a.jpg")
    listing = files_source.walk(spark, str(tmp_path))
    media, issues = inventory.discover(listing, symlinks="follow")
    assert media.count() == 1 and issues.count() == 1
    assert files_source.regular_files(spark, str(tmp_path)).count() >= 1


def test_files_above_the_content_bound_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files_source, "MAX_CONTENT", 10)
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff123")
    (tmp_path / "a.mov").write_bytes(b"x" * 11)
    rows = {r.path.rpartition("/")[2]: r for r in files_source.regular_files(spark, str(tmp_path), content=True).collect()}
    assert {n: (r.size, r.media_type, r.content is None, r.issue is None) for n, r in rows.items()} == {"a.jpg": (6, "image", False, True), "a.mov": (11, "video", True, False)}
    info = files_source.inspect(spark, str(tmp_path / "a.mov")).first()
    assert (info.size, info.header.width, bool(info.issue)) == (11, None, True)
