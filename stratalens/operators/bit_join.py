"""Pairs of bit strings within a Hamming distance, by exact bands and bounded comparison.

A string of bits is cut into bound + t bands. Two strings within the bound agree in at least t of them (pigeonhole), so
they meet under a key made of t bands; more rows want a larger t, with more but much rarer keys. Strings that share a
key are compared in one task as arrays of words, in order of how many bits they have set: only numbers that differ by
at most the bound are compared. A pair counts only under the first t bands in which it agrees, so no pair comes twice
and nothing has to be made distinct. Keys with more than `most` strings are cut into finer keys by bands over the bits
they don't hold yet, and what is still too large into blocks that are compared two by two; so no task ever holds more
than twice `most` strings of a key. Strings no longer than the bound all meet under one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.work import Workspace

#: Strings that are compared under one key; more are cut into finer keys or blocks.
MOST = 8192
#: Keys that one partition of the join should hold.
KEYS_PER_TASK = 500_000
#: Runs of at most so many strings are compared together, row against the d-th next row.
SHORT = 48
#: Cells of one array of distances.
CELLS = 1 << 21
#: Turns codes of some width, a line of bytes each, into lines of bits; the bits are what the bands are cut from.
Lines = Callable[[np.ndarray, int], np.ndarray]


def plain_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    """The last `bits` bits of every code."""
    return np.unpackbits(codes, axis=1)[:, -bits:]


def byte_lines(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Some rows of a binary column, all of one length, as a matrix of bytes."""
    taken = column.take(pa.array(rows)).cast(pa.binary())
    offsets = np.frombuffer(taken.buffers()[1], np.int32, len(rows) + 1)
    return np.frombuffer(taken.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(rows), -1)


def binary_column(lines: np.ndarray) -> pa.Array:
    """The lines of a matrix as a binary column, without a copy per row."""
    data = np.ascontiguousarray(lines).view(np.uint8)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def band_plan(bits: int, bound: int, joint: int = 1) -> list[tuple[int, int, int, int, int, int]]:
    """(bits, band, word, first bit, width, radius) of the bound + joint bands; all are looked up exactly. None for bound >= bits."""
    if bound >= bits:
        return []
    bands = min(bound + joint, bits)
    cuts = [bits * i // bands for i in range(bands + 1)]
    return [(bits, i, cuts[i] // 64, cuts[i], cuts[i + 1] - cuts[i], 0) for i in range(bands)]


def probes(bits: int, bound: int, joint: int = 1) -> list[tuple[int, ...]]:
    """The bands that make up each key of a string: all combinations of `joint` bands, or one key without bands."""
    plan = band_plan(bits, bound, joint)
    return list(combinations(range(len(plan)), joint)) if plan else [()]


def choose_joint(bits: int, bound: int, rows: int) -> int:
    """How many bands a key should hold for so many rows: shuffled keys against compared pairs (measured in keys)."""

    def cost(joint: int) -> float:
        bands = bound + joint
        return comb(bands, joint) * (1 + rows / 2.0 ** min(60.0, bits * joint / bands) / 3000)

    return min((j for j in (1, 2, 3) if bound + j <= bits), key=cost, default=1)


def as_words(lines: np.ndarray) -> np.ndarray:
    """Lines of bits as 64-bit words, padded with zeros."""
    padded = np.zeros((len(lines), -(-lines.shape[1] // 64) * 64), np.uint8)
    padded[:, : lines.shape[1]] = lines
    return np.packbits(padded, axis=1).view(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_of(base: np.ndarray, number: int, lines: np.ndarray) -> np.ndarray:
    """A 64-bit key of a base, the number of the combination and the bits chosen by it."""
    key = _mix(base + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for word in as_words(lines).T:
        key = _mix(key ^ word)
    return key


def _columns(plan: list, bands: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(plan[b][3], plan[b][3] + plan[b][4]) for b in bands)]).astype(np.int64)


def finer(bits: int, bound: int, joint: int, bands: tuple[int, ...]) -> list[np.ndarray]:
    """The bits outside the given bands, cut into bound + 1 finer bands; none if there are too few bits."""
    rest = np.setdiff1d(np.arange(bits), _columns(band_plan(bits, bound, joint), bands))
    return np.array_split(rest, bound + 1) if len(rest) > bound else []


def _masks(bits: int, parts: list[np.ndarray]) -> np.ndarray:
    lines = np.zeros((len(parts), bits), np.uint8)
    for i, part in enumerate(parts):
        lines[i, part] = 1
    return as_words(lines)


KEYS = "grp bigint, key bigint, combo int, fine int, side int, bits int, id {id}, many boolean, sketch binary"


def _by_width(batch: pa.RecordBatch, joints: dict[int, int], bounds: dict[int, int], lines_of: Lines) -> Iterator[tuple]:
    """(bits, rows, grp, lines of bits, plan, combinations of bands) for every width in a batch that has a bound."""
    widths = batch.column("bits").to_numpy()
    grp = batch.column("grp").to_numpy()
    for bits in np.unique(widths).tolist():
        if bounds.get(bits):
            rows = np.flatnonzero(widths == bits)
            lines = lines_of(byte_lines(batch.column("code"), rows), bits)
            yield bits, rows, grp[rows], lines, band_plan(bits, bounds[bits], joints[bits]), probes(bits, bounds[bits], joints[bits])


def _keyed(batches: Iterator[pa.RecordBatch], joints: dict[int, int], bounds: dict[int, int], lines_of: Lines) -> Iterator[pa.RecordBatch]:
    """(grp, bits, id, many, code) to one row per key."""
    for batch in batches:
        for bits, rows, grp, lines, plan, combos in _by_width(batch, joints, bounds, lines_of):
            index = pa.array(rows)
            id_, many, sketch, base = batch.column("id").take(index), batch.column("many").take(index), binary_column(as_words(lines)), grp.view(np.uint64)
            same = lambda value, n=len(rows): pa.array(np.full(n, value, np.int32))
            for number, bands in enumerate(combos):
                key = key_of(base, number, lines[:, _columns(plan, bands)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(key), same(number), same(-1), same(0), same(bits), id_, many, sketch], ["grp", "key", "combo", "fine", "side", "bits", "id", "many", "sketch"])


def _counted(batches: Iterator[pa.RecordBatch], joints: dict[int, int], bounds: dict[int, int], lines_of: Lines) -> Iterator[pa.RecordBatch]:
    """(grp, key, n): how often each key of _keyed() occurs in a batch."""
    for batch in batches:
        for _, _, grp, lines, plan, combos in _by_width(batch, joints, bounds, lines_of):
            for number, bands in enumerate(combos):
                key = key_of(grp.view(np.uint64), number, lines[:, _columns(plan, bands)]).view(np.int64)
                keys, first, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grp[first]), pa.array(keys), pa.array(n.astype(np.int64))], ["grp", "key", "n"])


def _refined(batches: Iterator[pd.DataFrame], joints: dict[int, int], bounds: dict[int, int]) -> Iterator[pd.DataFrame]:
    """Rows of keys that are too large, under finer keys."""
    for batch in batches:
        for (bits, number), rows in batch.groupby(["bits", "combo"], sort=False):
            bits, number = int(bits), int(number)
            bands = probes(bits, bounds[bits], joints[bits])[number]
            parts = finer(bits, bounds[bits], joints[bits], bands)
            if not parts:
                yield rows
                continue
            packed = np.frombuffer(b"".join(rows.sketch), np.uint8).reshape(len(rows), -1)
            lines = np.unpackbits(packed, axis=1)[:, :bits]
            base = rows.key.to_numpy(np.int64).view(np.uint64)
            for fine, columns in enumerate(parts):
                yield rows.assign(key=key_of(base, fine, lines[:, columns]).view(np.int64), fine=fine)


# ---------------------------------------------------------------- comparison within keys


def _short_runs(words: np.ndarray, size: np.ndarray, ends: np.ndarray, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs (i, j) of rows in one run; ends[i] is where the run of row i ends, i itself for rows to skip."""
    first, step = np.arange(len(words)), 1
    while len(first := first[first + step < ends[first]]):
        near = first[size[first + step] - size[first] <= bound]
        apart = np.bitwise_count(words[near] ^ words[near + step]).sum(1, dtype=np.int64)
        yield near[apart <= bound], near[apart <= bound] + step
        step += 1


def _long_run(words: np.ndarray, size: np.ndarray, start: int, end: int, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs (i, j) of the rows start .. end - 1, in order of size: block by block within the size band."""
    at = start
    while at < end:
        block = max(1, min(end - at, CELLS // (end - at)))
        stop = start + int(np.searchsorted(size[start:end], size[at + block - 1] + bound, "right"))
        apart = np.zeros((block, stop - at), np.uint16)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[at : at + block, w, None] ^ words[None, at:stop, w])
        i, j = np.nonzero(apart <= bound)
        yield at + i[i < j], at + j[i < j]
        at += block


def _agreeing(words: np.ndarray, i: np.ndarray, j: np.ndarray, masks: np.ndarray, wanted: np.ndarray, joint: int) -> np.ndarray:
    """Whether the first `joint` bands in which each pair agrees are the wanted ones."""
    same = ~((words[i] ^ words[j])[:, None, :] & masks[None]).any(2)
    first = same & (np.cumsum(same, axis=1) <= joint)
    return (first == wanted).all(1)


def _found(rows: pa.RecordBatch, joints: dict[int, int], bounds: dict[int, int]) -> Iterator[pa.RecordBatch]:
    widths = rows.column("bits").to_numpy()
    for bits in np.unique(widths).tolist():
        part = np.flatnonzero(widths == bits)
        bound, joint = bounds[bits], joints[bits]
        words = byte_lines(rows.column("sketch"), part).view(np.uint64)
        size = np.bitwise_count(words).sum(1, dtype=np.int64)
        grp, key = (rows.column(c).to_numpy()[part] for c in ("grp", "key"))
        order = np.lexsort((size, key, grp))
        words, size, grp, key = words[order], size[order], grp[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (key[1:] != key[:-1])]))
        counts = np.diff(np.concatenate([starts, [len(part)]]))
        ends = np.repeat(np.where(counts <= SHORT, starts + counts, 0), counts)
        found = list(_short_runs(words, size, ends, bound))
        for s, n in zip(starts[counts > SHORT].tolist(), counts[counts > SHORT].tolist(), strict=True):
            found += _long_run(words, size, s, s + n, bound)
        if not found:
            continue
        i, j = (np.concatenate(side) for side in zip(*found, strict=True))
        part = part[order]
        side, combo, fine = (rows.column(c).to_numpy()[part] for c in ("side", "combo", "fine"))
        keep = (side[i] == 0) | (side[i] != side[j])
        i, j = i[keep], j[keep]
        plan = band_plan(bits, bound, joint)
        masks = _masks(bits, [_columns(plan, (b,)) for b in range(len(plan))])
        chosen = probes(bits, bound, joint)
        keep = np.zeros(len(i), bool)
        for number in np.unique(combo[i]).tolist():
            of = np.flatnonzero(combo[i] == number)
            wanted = np.isin(np.arange(len(plan)), chosen[number])
            ok = _agreeing(words, i[of], j[of], masks, wanted, joint)
            if (cut := fine[i[of]] >= 0).any():
                parts = finer(bits, bound, joint, chosen[number])
                wanted = fine[i[of[cut]], None] == np.arange(len(parts))
                ok[cut] &= _agreeing(words, i[of[cut]], j[of[cut]], _masks(bits, parts), wanted, 1)
            keep[of] = ok
        i, j = i[keep], j[keep]
        ids, many = rows.column("id"), rows.column("many").to_numpy(zero_copy_only=False)[part]
        apart = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(part[i])), ids.take(pa.array(part[j])), pa.array(apart), pa.array(many[i] | many[j])], ["a", "b", "distance", "many"])


def _compared(batches: Iterator[pa.RecordBatch], joints: dict[int, int], bounds: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, key) to close pairs; a key that runs over the end of a batch waits for the next one."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        grp, key = rows.column("grp").to_numpy(), rows.column("key").to_numpy()
        other = np.flatnonzero((grp != grp[-1]) | (key != key[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = rows.slice(cut)
        if cut:
            yield from _found(rows.slice(0, cut), joints, bounds)
    if held is not None:
        yield from _found(held, joints, bounds)


def close_codes(ws: Workspace, codes: DataFrame, bound_of: Callable[[int], int], lines_of: Lines = plain_bits, joint: int | None = None, most: int = MOST) -> DataFrame:
    """(a, b, distance, many), a < b: different codes of one space and width that differ in at most bound_of(width) bits.

    codes: a stored table (id, many, space, bits, code) without repeated (space, bits, code) and ids; many is handed
    through for either of the two. joint overrides the choice of the bands per key.
    """
    sizes = codes.groupBy("space", "bits").agg(F.count("*").alias("n")).groupBy("bits").agg(F.max("n").alias("n"), F.sum("n").alias("total")).collect()  # one row per width
    bounds = {r.bits: bound_of(r.bits) for r in sizes}
    joints = {r.bits: min(joint or choose_joint(r.bits, bounds[r.bits], r.n), max(1, r.bits - bounds[r.bits])) for r in sizes}
    total = sum(r.total * len(probes(r.bits, bounds[r.bits], joints[r.bits])) for r in sizes if bounds[r.bits])
    kind = codes.schema["id"].dataType
    schema = KEYS.format(id=kind.simpleString())
    rows = codes.select(F.xxhash64("space", "bits").alias("grp"), "bits", "id", "many", "code")
    keys = rows.mapInArrow(lambda batches: _keyed(batches, joints, bounds, lines_of), schema)

    def large(counts: DataFrame, name: str) -> DataFrame | None:
        """The keys with more than `most` rows, by counts that combine before their shuffle."""
        counted = ws.save(counts.groupBy("grp", "key").agg(F.sum("n").alias("n")).where(F.col("n") > most), name)
        return counted if counted.take(1) else None

    # two different (space, bits) whose grp and key are both equal would only be counted together
    if (hot := large(rows.mapInArrow(lambda batches: _counted(batches, joints, bounds, lines_of), "grp bigint, key bigint, n bigint"), "large")) is not None:
        parts = [keys.join(hot, ["grp", "key"], "left_anti")]
        columns = keys.columns
        fine = ws.save(keys.join(hot.drop("n"), ["grp", "key"], "left_semi").select(*columns).mapInPandas(lambda batches: _refined(batches, joints, bounds), schema), "fine")
        if (hotter := large(fine.select("grp", "key", F.lit(1).alias("n")), "larger")) is not None:
            parts.append(fine.join(hotter, ["grp", "key"], "left_anti"))
            blocks = fine.join(hotter, ["grp", "key"]).withColumn("of", F.ceil(F.col("n") / most).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
            blocks = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
            side = F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2)
            parts.append(blocks.withColumn("side", side).withColumn("key", F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))).select(*columns))
        else:
            parts.append(fine)
        keys = parts[0].select(*columns)
        for part in parts[1:]:
            keys = keys.unionByName(part.select(*columns))
    # no key has more than twice `most` rows now, so plain hash partitions are even
    partitions = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // KEYS_PER_TASK)
    met = keys.repartition(partitions, "grp", "key").sortWithinPartitions("grp", "key")
    close = met.mapInArrow(lambda batches: _compared(batches, joints, bounds), T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("distance", T.IntegerType()), T.StructField("many", T.BooleanType())]))
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", "many")
