"""Evaluation passages in training text, found by a stored FM-index of every training shard.

build_index() reads the corpus once. A shard is some million words of documents; all their words, numbered in the
shard's own vocabulary, are the text of its index: a suffix array by prefix doubling, its Burrows-Wheeler transform as
a wavelet matrix, and sampled suffix positions. The shards are the rows of a table in the shared folder, which holds
everything a search needs, so any set of test items is searched, with any length of window, without the documents.

search_index() cuts the items into windows of `least` words and searches them backwards through the wavelet ranks of
each shard, all at once; occurrences walk back to a sampled position and are merged into spans. Shards are independent;
nothing is gathered from the corpus but the spans. removal_spans() merges the spans of all items per document.

Words are runs of letters and digits in lower case; whatever stands between them is ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.work import Workspace

WORD = re.compile(r"[^\W_]+")
SAMPLE = 8


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray | None = None, words: np.ndarray | None = None) -> None:
        if words is None:
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, at = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << at) - np.uint64(1))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1


class Wavelet:
    """A wavelet matrix: rank and access for sequences of small numbers."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels: list[Bits] = []
        self.height = max(1, int(symbols - 1).bit_length())
        for level in range(self.height - 1, -1, -1):
            bits = (sequence >> level) & 1
            self.levels.append(Bits(bits))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.zeros = [len(sequence) - b.ones for b in self.levels]

    @classmethod
    def stored(cls, levels: list[bytes], length: int) -> Wavelet:
        """The wavelet matrix of the words of its levels."""
        self = cls.__new__(cls)
        self.levels = [Bits(words=np.frombuffer(data, np.uint64)) for data in levels]
        self.height = len(self.levels)
        self.zeros = [length - b.ones for b in self.levels]
        return self

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.height - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, i) - self._descend(symbol, np.zeros_like(i))

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = bits.get(i), bits.rank(i)
            symbol = symbol * 2 + bit
            i = np.where(bit, zeros + ones, i - ones)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, where zeros are separators, smaller than all words, that order by position and end comparison."""
    n = len(text)
    width = max(1, int(text.max(initial=0)).bit_length())
    step = max(1, min(8, 63 // width))
    # the first `step` words as one number; what follows a separator doesn't count
    key, going = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(step):
        word = np.zeros(n, np.int64)
        word[: max(0, n - k)] = text[k:]
        key = (key << width) | np.where(going, word, 0)
        going &= word != 0
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    # suffixes that tie and reach a separator are in order already, by position
    starts = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]) | ~going[order][1:]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    open_ = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # rows of the order that still tie
    while len(open_):
        suffix = order[open_]
        group = rank[suffix]
        # no separator lies within `step` words of an open suffix, so the words compared never run over the end
        new = np.lexsort((rank[np.minimum(suffix + step, n - 1)], group))
        suffix, group = suffix[new], group[new]
        order[open_] = suffix
        tail = rank[np.minimum(suffix + step, n - 1)]
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (tail[1:] != tail[:-1])])
        begin = np.flatnonzero(first)
        count = np.diff(np.concatenate([begin, [len(suffix)]]))
        rank[suffix] = np.repeat(open_[begin], count)
        open_ = open_[np.repeat(count, count) > 1]
        step *= 2
    return order


class FMIndex:
    """Search in a text of word numbers from 1; zeros separate runs. The text must end with a separator."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_array(text)
        self.n, self.symbols = len(text), symbols
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols]
        # the start of a run is always sampled, so no walk back ever crosses a separator
        marked = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.marked, self.positions = Bits(marked), order[marked]

    @classmethod
    def stored(cls, n: int, first: bytes, levels: list[bytes], marked: bytes, positions: bytes) -> FMIndex:
        """The index from the parts that row() gave."""
        self = cls.__new__(cls)
        self.n, self.first = n, np.frombuffer(first, np.int64)
        self.symbols = len(self.first)
        self.wavelet = Wavelet.stored(levels, n)
        self.marked, self.positions = Bits(words=np.frombuffer(marked, np.uint64)), np.frombuffer(positions, np.int32)
        return self

    def row(self) -> tuple[int, bytes, list[bytes], bytes, bytes]:
        """What is stored of it: (length, first, levels, marked, positions)."""
        return self.n, self.first.tobytes(), [b.words.tobytes() for b in self.wavelet.levels], self.marked.words.tobytes(), self.positions.astype(np.int32).tobytes()

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each pattern, one per line."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        low[dead] = high[dead] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, by walking back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            hit = self.marked.get(here) == 1
            out[live[hit]] = self.positions[self.marked.rank(here[hit])] + steps[live[hit]]
            live, here = live[~hit], here[~hit]
            symbol = self.wavelet.access(here)
            at[live] = self.first[symbol] + self.wavelet.rank(symbol, here)
            steps[live] += 1
        return out


def windows(items: list[tuple[int, list[int]]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct windows, then for each (window, item) that holds it: window number and item), items as word numbers."""
    lines = [(w[i : i + least], item) for item, w in items for i in range(len(w) - least + 1)]
    if not lines:
        return np.zeros((0, least), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    patterns, inverse = np.unique(np.array([w for w, _ in lines], np.int64), axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([inverse.ravel(), [item for _, item in lines]]), axis=0)
    return patterns, pairs[:, 0], pairs[:, 1]


class Shard:
    """Documents gathered for one index: their words as numbers of a vocabulary that grows with them."""

    def __init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.text, self.starts, self.idents = array("i"), array("i"), []

    def add(self, ident: str | None, words: list[str]) -> None:
        number, known = self.vocabulary.setdefault, self.vocabulary
        self.idents.append(ident)
        self.starts.append(len(self.text))
        self.text.extend([number(w, len(known) + 1) for w in words])
        self.text.append(0)

    def row(self) -> tuple:
        """(n, first, levels, marked, positions, vocabulary, starts, idents) of its index."""
        index = FMIndex(np.array(self.text, np.int32), len(self.vocabulary) + 1)
        return *index.row(), zlib.compress("\n".join(self.vocabulary).encode(), 1), self.starts.tobytes(), self.idents


def shard_spans(index: FMIndex, vocabulary: dict[str, int], starts: np.ndarray, names: list[str], patterns: np.ndarray, window: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, item, first word, last word) of the merged spans in one shard; documents and items by number.

    names are the words that the patterns number from 1 on; a window with a word that the shard lacks isn't searched.
    """
    nothing = np.zeros(0, np.int64)
    local = np.array([0, *(vocabulary.get(w, 0) for w in names)], np.int64)[patterns]
    known = np.flatnonzero((local > 0).all(1))
    if not len(known):
        return nothing, nothing, nothing, nothing
    low, high = index.search(local[known])
    count = high - low
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    where, which = index.locate(rows), np.repeat(known, count)
    doc = np.searchsorted(starts, where, "right") - 1
    # every item that holds the window found
    owners = np.searchsorted(window, [which, which + 1])
    times = owners[1] - owners[0]
    at = np.repeat(owners[0], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    found = np.column_stack([np.repeat(doc, times), item[at], np.repeat(where - starts[doc], times)])
    if not len(found):
        return nothing, nothing, nothing, nothing
    found = np.unique(found, axis=0)
    fresh = np.concatenate([[True], (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1]) | (found[1:, 2] > found[:-1, 2] + least)])
    begin = np.flatnonzero(fresh)
    end = np.concatenate([begin[1:], [len(found)]]) - 1
    return found[begin, 0], found[begin, 1], found[begin, 2], found[end, 2] + least - 1


#: idents are kept as text, exact whatever else is in a batch; the column `like` is null and tells their type.
SHARD = "n bigint, first binary, levels array<binary>, marked binary, positions binary, vocabulary binary, starts binary, idents array<string>"
SHARD_WORDS = 1_000_000


def build_index(documents: DataFrame, ident: str, text: str, path: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Write the index of all documents to path, one row per shard, and read it back; null and empty texts are in no shard.

    Each worker indexes what its partition holds, about shard_words words (or one document) at a time.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard()
        indexed = lambda: pd.DataFrame([shard.row()], columns=[f.split()[0] for f in SHARD.split(", ")])
        for batch in batches:
            for doc, value in zip(batch.ident, batch.text, strict=True):
                if words := split_words(value):
                    shard.add(doc, words)
                if len(shard.text) >= shard_words:
                    yield indexed()
                    shard = Shard()
        if shard.idents:
            yield indexed()

    kind = documents.schema[ident].dataType
    corpus = documents.select(F.col(ident).cast("string").alias("ident"), F.col(text).alias("text")).where("text IS NOT NULL")
    index = corpus.mapInPandas(work, SHARD).withColumn("like", F.lit(None).cast(kind))
    index.write.parquet(path)
    return documents.sparkSession.read.schema(index.schema).parquet(path)


def search_index(index: DataFrame, items: DataFrame, item_ident: str, item_text: str, least: int = 13, block_words: int = 2_000_000) -> DataFrame:
    """(ident, item, first_word, last_word): spans of indexed documents that repeat at least `least` consecutive words of an item.

    The items are the stated query set: they are taken in blocks of block_words words, each broadcast and run against
    all shards. Null and empty texts, and items of fewer words, give nothing. Spans of one item that touch are merged.
    """
    spark = index.sparkSession
    kinds = index.schema["like"].dataType, items.schema[item_ident].dataType
    queries = items.select(F.col(item_ident).cast("string").alias("ident"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    total = queries.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    blocks = int(total // block_words) + 1
    result = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("ident", "text"), F.lit(blocks)) == block).toPandas()
        spans = index.drop("like").mapInPandas(_searcher(spark, rows, least), "ident string, item string, first_word bigint, last_word bigint")
        result = spans if result is None else result.unionByName(spans)
    return result.select(F.col("ident").cast(kinds[0]).alias("ident"), F.col("item").cast(kinds[1]).alias("item"), "first_word", "last_word")


def _searcher(spark, rows: pd.DataFrame, least: int):
    idents = list(rows.ident)
    lists = [words if len(words) >= least else [] for words in map(split_words, rows.text)]
    names = sorted({w for words in lists for w in words})
    number = {w: i + 1 for i, w in enumerate(names)}
    patterns, window, item = windows([(i, [number[w] for w in words]) for i, words in enumerate(lists)], least)
    shared = spark.sparkContext.broadcast((idents, names, patterns, window, item))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idents, names, patterns, window, item = shared.value
        for batch in batches:
            for shard in batch.itertuples(index=False):
                index = FMIndex.stored(shard.n, shard.first, list(shard.levels), shard.marked, shard.positions)
                vocabulary = {w: i + 1 for i, w in enumerate(zlib.decompress(shard.vocabulary).decode().split("\n"))}
                doc, which, first, last = shard_spans(index, vocabulary, np.frombuffer(shard.starts, np.int32).astype(np.int64), names, patterns, window, item, least)
                found = [(shard.idents[d], idents[i], a, b) for d, i, a, b in zip(doc.tolist(), which.tolist(), first.tolist(), last.tolist(), strict=True)]
                yield pd.DataFrame(found, columns=["ident", "item", "first_word", "last_word"])

    return work


def leaks(documents: DataFrame, ident: str, text: str, items: DataFrame, item_ident: str, item_text: str, least: int = 13, shard_words: int = SHARD_WORDS, block_words: int = 2_000_000) -> DataFrame:
    """build_index() in the work folder and search_index() in one; use the two apart to search several sets of items."""
    ws = Workspace(documents.sparkSession, "leaks")
    index = build_index(documents, ident, text, f"{ws.root}/index", shard_words)
    return search_index(index, items, item_ident, item_text, least, block_words)


def removal_spans(spans: DataFrame) -> DataFrame:
    """(ident, first_word, last_word): the spans of all items merged per document, where they overlap or touch."""
    window = Window.partitionBy("ident").orderBy("first_word", "last_word")
    reach = F.max("last_word").over(window.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("ident", "first_word", "last_word").distinct().withColumn("fresh", F.coalesce(F.col("first_word") > reach + 1, F.lit(True)))
    marked = marked.withColumn("n", F.sum(F.col("fresh").cast("int")).over(window))
    return marked.groupBy("ident", "n").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")).drop("n")
