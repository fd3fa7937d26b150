"""Full-text search over some columns of a table: postings with positions, phrases, and BM25 relevance.

Tokens are runs of letters and digits in lower case without accents; everything else, underscores included, separates.
Queries and texts are folded by one table. A query's white-space separated terms are phrases that must all occur, each
within one column; no prefixes. matches() takes raw expressions: "phrases", AND, OR, NOT, prefix*, column:term and
parentheses; other syntax is an error. Relevance is negative, best first, as in the usual embedded full-text engines
(k1 = 1.2, b = 0.75). search() reads the texts; SearchIndex keeps postings, of which a query reads those of its tokens.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.errors import ReportError

K1, B = 1.2, 0.75
#: Files into which the postings are parted by the hash of their token.
BUCKETS = 64


@lru_cache(1)
def folding() -> tuple[str, str]:
    """The letters that are a base letter with accents, and those base letters, by the Unicode decompositions (for translate)."""
    pairs = []
    for code in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isalpha() and all(unicodedata.combining(m) for m in marks):
            pairs.append((chr(code), base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def plain(text: str) -> list[str]:
    """The tokens of a query term."""
    low = text.lower().translate(str.maketrans(*folding()))
    low = "".join(c for c in low if not unicodedata.category(c).startswith("M"))
    return re.findall(r"[^\W_]+", low)


def tokens(text: Column) -> Column:
    low = F.regexp_replace(F.translate(F.lower(text), *folding()), r"\p{M}", "")
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrases(query: str) -> list[list[str]]:
    """The phrases of a query; blank queries have none. Double quotes keep several words together."""
    parts = re.findall(r'"([^"]*)"|(\S+)', query)
    return [p for a, b in parts if (p := plain(a or b))]


def postings(rows: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """(doc, col, pos, token) of every token."""
    made = [rows.select(F.col(ident).alias("doc"), F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "token")) for c in columns]
    result = made[0]
    for part in made[1:]:
        result = result.unionByName(part)
    return result


def search(rows: DataFrame, ident: str, columns: list[str], query: str) -> DataFrame:
    """(doc, score) of the rows with all phrases; an empty query finds nothing."""
    wanted = phrases(query)
    if not wanted:
        return rows.select(F.col(ident).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    # one pass over the texts: the length of a row, and how often each phrase occurs in its columns
    lists = rows.select(F.col(ident).alias("doc"), *[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias(f"t{i}") for i, c in enumerate(columns)])
    # every token between blanks of its own, columns apart, so that a phrase is a plain piece of text
    joined = F.concat_ws("|", *[F.concat(F.lit(" "), F.array_join(f"t{i}", "  "), F.lit(" ")) for i in range(len(columns))])
    length = sum((F.size(f"t{i}") for i in range(1, len(columns))), F.size("t0"))
    lists = lists.select("doc", length.alias("len"), joined.alias("words"))
    hits = [F.regexp_count("words", F.lit(f"(?= {'  '.join(p)} )")) for p in wanted]
    counted = lists.select("doc", "len", *[h.alias(f"h{i}") for i, h in enumerate(hits)])
    totals = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"h{i}") > 0).alias(f"n{i}") for i in range(len(wanted))])
    every = F.lit(True)
    for i in range(len(wanted)):
        every = every & (F.col(f"h{i}") > 0)
    return counted.where(every).crossJoin(F.broadcast(totals)).select("doc", (-_relevance(len(wanted))).alias("score"))  # totals is one row


class SearchIndex:
    """Postings and row lengths of some columns, stored under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, ident: str, columns: list[str]) -> SearchIndex:
        """Write the index of all rows, replacing what is there. A row without text in any column counts, with length 0."""
        found = postings(rows, ident, columns).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"))
        # a token that a third of all rows hold is spread over its bucket's files, not gathered in one task
        found = found.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "token", "doc", "col", "pos")
        found.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        size = lambda c: F.coalesce(F.size(tokens(F.col(c))), F.lit(0))
        rows.select(F.col(ident).alias("doc"), sum((size(c) for c in columns[1:]), size(columns[0])).alias("len")).write.mode("overwrite").parquet(f"{self.path}/lengths")
        return self

    def _hits(self, phrase: list[str]) -> DataFrame:
        """(doc, h): how often the phrase occurs in each row's columns."""
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in dict.fromkeys(phrase)], "token string").select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")).collect()]
        kind = self.spark.read.parquet(f"{self.path}/lengths").schema["doc"].dataType.simpleString()
        stored = self.spark.read.schema(f"doc {kind}, col string, pos int, token string, bucket int").parquet(f"{self.path}/postings").where(F.col("bucket").isin(*buckets))
        at = lambda n: stored.where(F.col("token") == phrase[n]).select("doc", "col", (F.col("pos") - n).alias("start"))
        starts = at(0)
        for n in range(1, len(phrase)):
            starts = starts.join(at(n), ["doc", "col", "start"])
        return starts.groupBy("doc").agg(F.count("*").alias("h"))

    def search(self, query: str) -> DataFrame:
        """What search() finds over the indexed rows: (doc, score) of those with all phrases. Row idents must not repeat."""
        wanted = phrases(query)
        lengths = self.spark.read.parquet(f"{self.path}/lengths")
        if not wanted:
            return lengths.select("doc", F.lit(0.0).alias("score")).limit(0)
        found, totals = None, lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
        for i, phrase in enumerate(wanted):
            hits = self._hits(phrase).withColumnRenamed("h", f"h{i}")
            totals = totals.crossJoin(hits.agg(F.count("*").alias(f"n{i}")))  # one row each
            found = hits if found is None else found.join(hits, "doc")
        scored = found.join(lengths, "doc").crossJoin(F.broadcast(totals))  # totals is one row
        return scored.select("doc", (-_relevance(len(wanted))).alias("score"))


def _relevance(terms: int) -> Column:
    """BM25 over h0, h1, ... (occurrences), n0, n1, ... (rows with the phrase), len, n and avg."""
    score = F.lit(0.0)
    for i in range(terms):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * F.col(f"h{i}") * (K1 + 1) / (F.col(f"h{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return score


def ranked(rows: DataFrame, ident: str, columns: list[str], query: str, run: tuple[str, int] | None = None) -> DataFrame:
    """The matching rows, best first; run restricts the result (not the statistics) to column = value."""
    found = rows.join(search(rows, ident, columns, query).withColumnRenamed("doc", ident), ident)
    if run:
        found = found.where(F.col(run[0]) == run[1])
    return found.orderBy("score", ident)


def matches(rows: DataFrame, ident: str, columns: list[str], expression: str) -> DataFrame:
    """(doc) of the rows for which a raw expression holds; blank finds nothing."""
    parts = re.findall(r'"[^"]*"|[()]|[^\s()"]+', expression)
    if re.sub(r'"[^"]*"', "", expression).count('"'):
        raise ReportError("unbalanced quotes in the search expression", operation="search")
    if not parts:
        return rows.select(F.col(ident).alias("doc")).limit(0)
    texts = {c: F.concat(F.lit(" "), F.array_join(F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")), "  "), F.lit(" ")) for c in columns}
    condition, at = _either(parts, 0, texts)
    if at != len(parts):
        raise ReportError("the search expression can't be read", operation="search", details={"at": parts[at]})
    return rows.where(condition).select(F.col(ident).alias("doc"))


def _either(parts: list[str], at: int, texts: dict[str, Column]) -> tuple[Column, int]:
    left, at = _all(parts, at, texts)
    while at < len(parts) and parts[at] == "OR":
        right, at = _all(parts, at + 1, texts)
        left = left | right
    return left, at


def _all(parts: list[str], at: int, texts: dict[str, Column]) -> tuple[Column, int]:
    left, at = _term(parts, at, texts)
    while at < len(parts) and parts[at] not in ("OR", ")"):
        word = parts[at]
        right, at = _term(parts, at + (word in ("AND", "NOT")), texts)
        left = left & (~right if word == "NOT" else right)
    return left, at


def _term(parts: list[str], at: int, texts: dict[str, Column]) -> tuple[Column, int]:
    if at >= len(parts) or parts[at] in (")", "AND", "OR", "NOT"):
        raise ReportError("the search expression lacks a term", operation="search")
    if parts[at] == "(":
        inner, at = _either(parts, at + 1, texts)
        if at >= len(parts) or parts[at] != ")":
            raise ReportError("unbalanced parentheses in the search expression", operation="search")
        return inner, at + 1
    word, within = parts[at], texts
    column, colon, rest = word.partition(":")
    if colon and word[0] != '"':
        if column not in texts:
            raise ReportError(f"no such column: {column}", operation="search")
        within = {column: texts[column]}
        word = rest or (parts[at + 1] if at + 1 < len(parts) else "")
        at += not rest
    prefix = word.endswith("*")
    found = plain(word.strip('"*'))
    if not found or re.search(r"[*^+]", word[:-1] if prefix else word):
        raise ReportError("the search expression can't be read", operation="search", details={"term": word})
    needle = " " + "  ".join(found) + ("" if prefix else " ")
    condition = F.lit(False)
    for text in within.values():
        condition = condition | text.contains(needle)
    return condition, at + 1
