"""Filling containers of fixed capacity with texts, by harmonic packing.

Lengths fall into reciprocal classes: class j holds lengths in (capacity/(j+1), capacity/j], so any j of them fit into
one container. Every worker packs what its partition holds, window by window of WINDOW texts, without looking at
others: per class it fills containers with exactly j items; the room that is left in a container is itself a capacity
of some class, and takes items of the classes that surely fit, largest first. What doesn't complete a container, and
the last class of short items, goes by falling length into the container with the least room that suffices, found in
a table of rooms. No row is shuffled, and a worker keeps numbers only, no texts, of one window at a time.

Texts longer than a container are cut into full containers and one rest, which is an item like any other; no other
text is cut. Null and empty texts take no part. Repeated rows are packed once each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published splitting pattern of the byte-level 50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes 1 to CLASSES - 1 are reciprocal; shorter items form the last one.
CLASSES = 64
#: Texts that a worker packs at a time; each window leaves a few containers that aren't full.
WINDOW = 100_000


@lru_cache(1)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def harmonic(sizes: list[int], capacity: int, classes: int = CLASSES) -> list[int]:
    """The container number of each item, 0 first; all sizes are from 1 to capacity."""
    held: list[list[int]] = [[] for _ in range(classes + 1)]
    for i, size in enumerate(sizes):
        held[min(capacity // size, classes)].append(i)
    held[classes].sort(key=sizes.__getitem__)  # the last class has items of many lengths: longest last
    place, rooms = [0] * len(sizes), 0

    def put(i: int, bin_: int, room: int) -> int:
        place[i] = bin_
        return room - sizes[i]

    def fill(bin_: int, room: int, above: int) -> None:
        """Items of classes beyond `above` for the room left; class k surely fits into room if capacity / k <= room."""
        k = above + 1
        while room > 0:
            k = max(k, -(-capacity // room))
            while k < classes and not held[k]:
                k += 1
            if k >= classes:
                break
            room = put(held[k].pop(), bin_, room)
        small = held[classes]
        while small and sizes[small[-1]] <= room:
            room = put(small.pop(), bin_, room)

    rest: list[int] = []
    for j in range(1, classes):
        while len(held[j]) >= j:
            room = capacity
            for _ in range(j):
                room = put(held[j].pop(), rooms, room)
            fill(rooms, room, j)
            rooms += 1
        rest += held[j]
        held[j] = []
    # the incomplete containers of all classes, and the last class: best fit by falling length. Bit r of `there` tells
    # whether a container with room r is open, so the least room that suffices is one step away.
    open_: dict[int, list[int]] = {}
    there = 0
    for i in sorted(rest, key=lambda i: -sizes[i]) + held[classes][::-1]:
        fitting = there >> sizes[i]
        if fitting:
            room = sizes[i] + (fitting & -fitting).bit_length() - 1
            bin_ = open_[room].pop()
            if not open_[room]:
                there ^= 1 << room
        else:
            bin_, room, rooms = rooms, capacity, rooms + 1
        if left := put(i, bin_, room):
            open_.setdefault(left, []).append(bin_)
            there |= 1 << left
    return place


def pack(documents: DataFrame, ident: str, text: str, capacity: int = 2048, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", window: int = WINDOW) -> DataFrame:
    """(ident, piece, first_token, n_tokens, container): where every token of every non-empty text lies.

    vocabulary is the path of a public tokenizer's rank file; it is read once and broadcast (about 1 MB, fixed).
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    with open(vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    columns = ["ident", "piece", "first_token", "n_tokens", "container"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoding = _encoding(ranks.value)
        context = TaskContext.get()
        taken = (context.partitionId() if context else 0) << 40
        rows: list[tuple] = []
        items: list[tuple] = []

        def packed() -> pd.DataFrame:
            nonlocal taken
            place = harmonic([item[3] for item in items], capacity)
            rows.extend((*item, taken + at) for item, at in zip(items, place, strict=True))
            taken += max(place, default=-1) + 1
            done = pd.DataFrame(rows, columns=columns)
            rows.clear()
            items.clear()
            return done

        for batch in batches:
            for doc, value in zip(batch.ident, batch.text, strict=True):
                if not value:
                    continue
                full, left = divmod(len(encoding.encode_ordinary(value)), capacity)
                rows.extend((doc, piece, piece * capacity, capacity, taken + piece) for piece in range(full))
                taken += full
                if left:
                    items.append((doc, full, full * capacity, left))
                if len(items) >= window or len(rows) >= window:
                    yield packed()
        yield packed()

    # idents travel as text, so that a null among them doesn't turn the others into floating-point numbers
    rows = documents.select(F.col(ident).cast("string").alias("ident"), F.col(text).alias("text")).mapInPandas(work, "ident string, piece int, first_token bigint, n_tokens int, container bigint")
    return rows.select(F.col("ident").cast(documents.schema[ident].dataType).alias(ident), "piece", "first_token", "n_tokens", "container")
