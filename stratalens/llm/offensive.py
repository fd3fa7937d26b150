"""Scores of abusive, hateful and sexual language, by a weighted lexicon in an Aho-Corasick automaton.

A text is folded first: lower case, accents off, look-alike letters of other scripts and digits or signs written for
letters replaced, invisible characters dropped, letters repeated three times or more written once, and everything
between letters removed. A phrase counts only where it begins and ends at a word of the text, so letters spaced or
broken by signs are found, and words inside other words are not. Masked words (b***h, b*tch, f***) are filled in from
the lexicon's marked words.

Evidence is normalised by length: a passage is a stretch of at most WINDOW letters, and its score is the sum of its
distinct phrases, without those inside an exception phrase or a longer phrase; belittling words and other weak signs
alone never reach THRESHOLD. A document belongs to a category if one of its passages reaches THRESHOLD, so a long text
with one such passage does; the score of the whole document is its total evidence per thousand letters. All steps are
sweeps over the phrases found. Null and empty texts score 0 and belong to none.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.lexicon import EXCEPTIONS, FOLDS, LEXICON

THRESHOLD = 1.0
#: A passage spans at most so many letters.
WINDOW = 160
#: Phrases below STRONG add up to WEAK_MOST at most.
STRONG, WEAK_MOST = 0.5, 0.9
CATEGORIES = tuple(LEXICON)
_TOKENS = re.compile(r"[a-z]+")
_STARRED = re.compile(r"[a-z*]+")
_REPEATS = re.compile(r"([a-z])\1{2,}")
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]


class _Folding(dict):
    """A translation table that learns: letters lose their accents, other characters become blanks."""

    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFKD", chr(code)).lower()
        out = "".join(FOLDS.get(c, c if "a" <= c <= "z" else "" if unicodedata.combining(c) else " ") for c in base) or ""
        self[code] = out if out.strip() or not unicodedata.combining(chr(code)) else ""
        return self[code]


_FOLDING = _Folding({code: "" for code in _INVISIBLE} | {ord(k): v for k, v in FOLDS.items()} | {c: chr(c).lower() for c in range(65, 91)} | {c: chr(c) for c in range(97, 123)})


def fold(text: str) -> list[str]:
    """The folded words of a text; masked words keep their stars, other stars part words."""
    folded = _REPEATS.sub(r"\1", text.lower().translate(_FOLDING))
    if "*" not in folded:
        return _TOKENS.findall(folded)
    return [w for token in _STARRED.findall(folded) for w in _unstarred(token)]


def _unstarred(token: str) -> list[str]:
    if "*" not in token:
        return [token]
    core = token.strip("*")
    if "*" not in core:  # stars around a word; three or more after its first letters may hide the rest
        return [core.ljust(len(token), "*")] if token[0] != "*" and token.endswith("***") and unmasked(token) else [core] * bool(core)
    return [core] if unmasked(core) else _TOKENS.findall(core)


@lru_cache(1)
def _marked() -> dict[int, list[tuple[str, str]]]:
    """length -> (form, folded word) of all marked words. A mask hides accents, umlauts and double letters alike, so a
    word is also looked for as it is written and with double letters written once."""
    table: dict[int, dict[tuple[str, str], None]] = {}
    for weights in LEXICON.values():
        for part in (part for group in weights.values() for phrase in group for part in phrase.split() if part[0] == "~"):
            word = "".join(fold(part[1:]))
            written = part[1:].lower()
            loose = word[0] + "?" * (len(written) - 2) + word[-1] if len(written) != len(word) else word
            for form in (word, re.sub(r"(.)\1", r"\1", word), loose):
                table.setdefault(len(form), {})[form, word] = None
    return {n: list(known) for n, known in table.items()}


@lru_cache(50_000)
def unmasked(token: str) -> str | None:
    """The marked word behind a starred token: the first in the lexicon that fits; the first letter must show."""
    fits = dict.fromkeys(word for form, word in _marked().get(len(token), ()) if all(c in ("*", f) or f == "?" and c == "*" for c, f in zip(token, form, strict=True)))
    return next(iter(fits), None) if token[0] != "*" else None


def _spellings(phrase: str) -> set[str]:
    """The folded forms of a lexicon phrase without blanks: plain, and with a marked word's double letters written once."""
    words = ["".join(fold(p.lstrip("~"))) for p in phrase.split()]
    out = {"".join(words)}
    for i, part in enumerate(phrase.split()):
        if part[0] == "~":
            out.add("".join([*words[:i], re.sub(r"(.)\1", r"\1", words[i]), *words[i + 1 :]]))
    return out


@lru_cache(1)
def automaton():
    import ahocorasick

    entries: dict[str, dict[tuple[str, str], float]] = {}
    for category, weights in LEXICON.items():
        for weight, phrases in weights.items():
            for phrase in phrases:
                for form in _spellings(phrase):
                    known = entries.setdefault(form, {})
                    known[category, phrase] = max(weight, known.get((category, phrase), 0.0))
    for phrase in EXCEPTIONS:
        for form in _spellings(phrase):
            entries.setdefault(form, {})["", phrase] = 0.0
    machine = ahocorasick.Automaton()
    for form, meanings in entries.items():
        machine.add_word(form, (len(form), [(category, weight, phrase) for (category, phrase), weight in meanings.items()]))
    machine.make_automaton()
    return machine


Hit = tuple[int, int, float, str]


def _spared(hits: list[Hit], exceptions: list[tuple[int, int]]) -> list[Hit]:
    """The hits that lie in no exception."""
    exceptions.sort()
    starts, reach = [a for a, _ in exceptions], list(accumulate((b for _, b in exceptions), max))
    return [h for h in hits if not (n := bisect_right(starts, h[0])) or reach[n - 1] < h[1]]


def _outer(hits: list[Hit]) -> list[Hit]:
    """The hits that lie in no longer one of at least their weight. Only phrases that are still open when another
    begins can hold it: at most as many as the longest phrase has letters, times those that begin at one letter."""
    out, open_ = [], []
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        open_ = [o for o in open_ if o[1] > hit[0]]
        if not any(o[1] >= hit[1] and o[1] - o[0] > hit[1] - hit[0] and o[2] >= hit[2] for o in open_):
            out.append(hit)
            open_.append(hit)
    return out


def _strongest(hits: list[Hit]) -> float:
    """The best score of a stretch of WINDOW letters; hits are in order of their starts."""
    best, first = 0.0, 0
    count: dict[str, int] = {}
    strong = weak = 0.0
    for start, end, weight, phrase in hits:
        while hits[first][0] < end - WINDOW and hits[first][0] < start:
            _, _, old, gone = hits[first]
            count[gone] -= 1
            if not count[gone]:
                strong, weak = (strong - old, weak) if old >= STRONG else (strong, weak - old)
            first += 1
        count[phrase] = count.get(phrase, 0) + 1
        if count[phrase] == 1:
            strong, weak = (strong + weight, weak) if weight >= STRONG else (strong, weak + weight)
        best = max(best, strong + min(weak, WEAK_MOST))
    return best


def evidence(text: str | None) -> dict[str, tuple[float, float, int]]:
    """category -> (strongest passage, total evidence, letters of the text)."""
    words = fold(text) if text else []
    if any("*" in w for w in words):
        words = [(unmasked(w) or w.replace("*", "")) if "*" in w else w for w in words]
    squeezed = "".join(words)
    edges: list[int] | None = None
    spared: list[tuple[int, int]] = []
    by: dict[str, list[Hit]] = {}
    for last, (length, meanings) in automaton().iter(squeezed):
        if edges is None:
            edges = [0, *accumulate(map(len, words))]
        start, end = last + 1 - length, last + 1
        if edges[bisect_left(edges, start)] == start and edges[bisect_left(edges, end)] == end:
            for category, weight, phrase in meanings:
                if category:
                    by.setdefault(category, []).append((start, end, weight, phrase))
                else:
                    spared.append((start, end))
    out: dict[str, tuple[float, float, int]] = {}
    for category, hits in by.items():
        if found := _outer(_spared(hits, spared)):
            out[category] = (round(_strongest(found), 6), round(sum(h[2] for h in found), 6), len(squeezed))
    return out


def score(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, category, passage, total, letters): one row per document and category with any evidence."""
    schema = "ident string, category string, passage double, total double, letters bigint"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, category, *values) for doc, value in zip(batch.ident, batch.text, strict=True) for category, values in evidence(value).items()]
            yield pd.DataFrame(rows, columns=["ident", "category", "passage", "total", "letters"])

    # idents travel as text, so that a null among them doesn't turn the others into floating-point numbers
    rows = documents.select(F.col(ident).cast("string").alias("ident"), F.col(text).alias("text")).mapInPandas(work, schema)
    return rows.withColumn("ident", F.col("ident").cast(documents.schema[ident].dataType))


def offensive(documents: DataFrame, ident: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(ident, category, score): the documents that belong to a category; score is the evidence per thousand letters."""
    return score(documents, ident, text).where(F.col("passage") >= threshold).select("ident", "category", (F.col("total") * 1000 / F.col("letters")).alias("score"))
