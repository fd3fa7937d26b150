"""Survivors, components and the sketch join against brute force."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalens.llm.components import components
from stratalens.llm.queries import p1_found
from stratalens.llm.sketch_join import band_plan, near_classes, near_pairs, near_sets, parity_words, probes
from stratalens.llm.survivors import best_records, merged_records
from tests.brute_time import instant

SMALL = "/root/testdata/sf0.001"


def union_find(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {x: top(x) for x in up}


def shapes():
    rnd = random.Random(7)
    yield "chain", [(f"c{i:04}", f"c{i + 1:04}") for i in range(300)]
    yield "ring", [(f"r{i:02}", f"r{(i + 1) % 40:02}") for i in range(40)]
    yield "star", [("hub", f"s{i}") for i in range(200)]
    yield "clique", [(f"q{i}", f"q{j}") for i in range(8) for j in range(i)]
    yield "tree", [(f"t{i}", f"t{rnd.randrange(i)}") for i in range(1, 300)]
    yield "lollipop", [(f"l{i}", f"l{j}") for i in range(5) for j in range(i)] + [(f"l{i}", f"l{i + 1}") for i in range(4, 60)]
    yield "two rings and a bridge", [(f"a{i}", f"a{(i + 1) % 9}") for i in range(9)] + [(f"b{i}", f"b{(i + 1) % 9}") for i in range(9)] + [("a0", "x"), ("x", "b0")]
    yield "loops at a hub", [("h", "h1"), ("h1", "h2"), ("h2", "h"), ("h", "h3"), ("h3", "h4"), ("h4", "h"), ("h", "h5")]
    yield "random", [(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(130)]
    yield "dirt", [("z", "z"), (None, "z"), ("z", None), ("p", "o"), ("o", "p"), ("p", "o"), ("é", "é"), ("", "blank")]


def test_components(spark):
    for kind in ("all", "none"):
        pairs = [p for _, ps in shapes() for p in ps] if kind == "all" else [("only", "only"), (None, None)]
        df = spark.createDataFrame([(*p, "extra") for p in pairs], "a string, b string, name string")
        got = components(df, "a", "b").collect()
        assert {r["name"]: r["group"] for r in got} == union_find(pairs) and len(got) == len(union_find(pairs))


def words(rnd, bits, base=None, flips=0):
    x = rnd.getrandbits(bits) if base is None else base
    for i in rnd.sample(range(bits), flips):
        x ^= 1 << i
    return x


def test_sketch_join(spark):
    rnd, rows, n = random.Random(3), [], 0
    for bits in (64, 256, 16, 12, 4, 68, 128):
        bases = [words(rnd, bits) for _ in range(6)]
        for base in bases:
            for flips in (0, 0, 1, 3, bits // 20, bits // 10, bits // 10 + 1):
                rows.append((n, f"{words(rnd, bits, base, min(flips, bits)):0{bits // 4}x}", rnd.choice(["image", "video"]), "x"))
                n += 1
    rows += [(9000, None, "image", "x"), (9001, "", "image", "x"), (9002, "xyz", "image", "x"), (9003, "0x", "image", "x"), (9004, "phash:8:44EC8A24368856CD", "image", "x"), (9005, " 0x44ec8a24368856cd\n", "image", "x"), (9006, "ahash:9:44ec8a24368856cd", "image", "x"), (9007, "44ec8a24368856cd", None, "x"), (None, "44ec8a24368856cd", "image", "x"), (9004, "phash:8:44EC8A24368856CD", "image", "x")]
    files = spark.createDataFrame(rows, "ord long, h string, media string, words string")
    want = {(9004, 9005): 0}
    good = [(o, h, m) for o, h, m, _ in rows if o is not None and o < 9000]
    for i, (o, h, m) in enumerate(good):
        for p, g, k in good[:i]:
            if m == k and len(h) == len(g) and (d := (int(h, 16) ^ int(g, 16)).bit_count()) <= len(h) * 4 // 10:
                want[p, o] = d
    got = near_pairs(files, "ord", "h", "media").collect()
    assert {(r.a, r.b): r.distance for r in got} == want and len(got) == len(want)
    assert near_pairs(files.limit(0), "ord", "h", "media").count() == 0


@pytest.mark.parametrize("bits", [4, 12, 16, 60, 64, 68, 128, 144, 256, 1024])
def test_bands_obey_the_pigeonhole(bits):
    bound = bits // 10
    plan = band_plan(bits, bound)
    assert sum(r + 1 for *_, r in plan) >= bound + 1
    used = {(w, at + i) for _, _, w, at, width, _ in plan for i in range(width)}
    assert len(used) == sum(width for *_, width, _ in plan) <= bits and all(width > 0 for *_, width, _ in plan)
    assert len(probes(bits, bound)) == sum(width + 1 if r else 1 for *_, width, r in plan)


@pytest.mark.parametrize(("joint", "most"), [(1, 8192), (2, 8192), (3, 64), (1, 6), (2, 3)])
def test_hot_keys_and_joint_bands(spark, joint, most):
    """Hashes that share most of their bits lie under few keys: finer keys, then blocks, must lose nothing."""
    rnd, rows = random.Random(11), []
    for bits, prefix in ((64, 40), (128, 100), (20, 12)):
        for i in range(90):
            low = rnd.getrandbits(bits - prefix) if i % 3 else rnd.getrandbits(6)
            rows.append((len(rows), f"{low:0{bits // 4}x}", "image"))
    files = spark.createDataFrame(rows, "ord long, h string, media string")
    want = {}
    for i, (o, h, _) in enumerate(rows):
        for p, g, _ in rows[:i]:
            if len(h) == len(g) and (d := (int(h, 16) ^ int(g, 16)).bit_count()) <= len(h) * 4 // 10:
                want[p, o] = d
    got = near_pairs(files, "ord", "h", "media", joint=joint, most=most).collect()
    assert {(r.a, r.b): r.distance for r in got} == want and len(got) == len(want)


def test_classes_of_equal_hashes(spark):
    rows = [(i, "00000000000000ff", "image") for i in range(5)] + [(7, "00000000000000fe", "image"), (8, "f0f0f0f0f0f0f0f0", "image"), (9, "00000000000000fe", "video")]
    sketches, members, links = near_classes(spark.createDataFrame(rows, "ord long, h string, media string"), "ord", "h", "media")
    assert {(r.id, r.n) for r in sketches.collect()} == {(0, 5), (7, 1), (8, 1), (9, 1)}
    assert {(r.id, r.ident) for r in members.collect()} == {(0, i) for i in range(5)}
    assert [(r.a, r.b, r.distance, r.many) for r in links.collect()] == [(0, 7, 1, True)]


def test_near_sets(spark):
    rnd, rows = random.Random(5), []
    for _ in range(12):
        base = [f"w{rnd.randrange(500)}" for _ in range(60)]
        for edits in (0, 1, 4, 12, 20):
            rows.append((len(rows), [w if i >= edits else f"v{rnd.randrange(900)}" for i, w in enumerate(base)], "x"))
    rows += [(900, None, "x"), (901, [], "x"), (902, [None, "a", "a"], "x"), (903, ["a"], "x"), (904, ["b"], "x"), (None, ["b"], "x")]
    least = {}
    for o, t, _ in rows:
        if o is not None and (s := frozenset(w for w in t or [] if w is not None)):
            least[s] = min(o, least.get(s, o))
    want = {tuple(sorted((least[x], least[y]))): len(x ^ y) for x in least for y in least if x != y and len(x ^ y) <= 25}
    df = spark.createDataFrame(rows, "ord long, t array<string>, tokens string")
    got = near_sets(df, "ord", "t").collect()
    assert {(r.a, r.b): r.differing for r in got} == want and len(got) == len(want)
    assert near_sets(df.limit(0), "ord", "t").count() == 0


def test_parity_sketch_bounds_the_symmetric_difference(spark):
    rnd = random.Random(5)
    rows = [([f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(40))],) for _ in range(12)] + [([],)]
    got = spark.createDataFrame(rows, "tokens array<string>").select("tokens", parity_words("tokens", 96).alias("w")).collect()
    for x in got:
        for y in got:
            assert sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x.w, y.w, strict=True)) <= len(set(x.tokens) ^ set(y.tokens))


def test_best_and_merged(spark):
    rows = [(1, 10, 0.5, None, "x"), (1, 11, 0.5, "b", None), (1, 12, None, "c", None), (1, 11, 0.5, "b", None), (None, 13, None, None, None)]
    df = spark.createDataFrame(rows, "g int, id int, q double, name string, __n string")
    best = best_records(df, ["g"], [F.col("q").desc_nulls_last()], "id").collect()
    assert {r.g: r.id for r in best} == {1: 10, None: 13}
    merged = {r.g: r for r in merged_records(df, ["g"], [-F.coalesce("q", F.lit(-1.0))], "id", {"name": F.col("name"), "note": F.col("__n")}).collect()}
    assert (merged[1].best_id, merged[1].name, merged[1].note, merged[None].name) == (10, "b", "x", None)
    assert best_records(df.limit(0), ["g"], [F.col("q").desc()], "id").count() == 0


def test_p1_against_brute_force(spark):
    read = lambda t: pd.read_parquet(f"{SMALL}/{t}.parquet")
    files = read("media_files").sort_values("loaded_at").drop_duplicates("id", keep="last")
    groups = read("duplicate_groups").sort_values("loaded_at").drop_duplicates("id", keep="last")
    live = set(zip(groups.id[groups.deleted_at.isna()], groups.run_id[groups.deleted_at.isna()], strict=True))
    zones = read("report_runs").set_index("id").tz_name
    best = {}
    for r in files[files.deleted_at.isna() & files.group_id.notna()].itertuples():
        if (int(r.group_id), r.run_id) in live:
            when = instant(r.creation_date, zones.get(r.run_id))
            key = (-(r.quality_score if 0 <= r.quality_score <= 1 else -1), -max(r.size_bytes, 0), -(when if when is not None else -(10**18)), r.id)
            best[int(r.group_id)] = min(best.get(int(r.group_id), key), key)
    assert dt is not None
    got = p1_found(spark, SMALL).collect()
    assert {r.group_id: r.file_id for r in got} == {g: k[-1] for g, k in best.items()} and len(got) == len(best)
