"""Digests and perceptual hashes as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.errors import HashError

PERCEPTUAL = ("ahash", "phash", "dhash", "whash")
CONTENT_LENGTHS = {"md5": 32, "sha256": 64}
#: One pattern for both spellings; its groups are algorithm, side and digits, or bare digits.
_DIGEST = r"(?U)\A\s*(?:([^:]*):\s*0*(\d{1,6})\s*:([0-9a-fA-F]+)|(?:0[xX])?([0-9a-fA-F]+))\s*\z"
#: The same with no white space inside.
_TIGHT = _DIGEST.replace(r":\s*0*(\d{1,6})\s*:", r":0*(\d{1,6}):")


def trim_all(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def digest_fields(text: Column, known: bool = True) -> Column:
    """array(side, digits, algorithm) of a digest's text, null if it has neither spelling.

    known allows white space around the side; without it white space may only stand around the whole text. Give it a
    column of its own (exploded from an array of one) before digest_of(), so that the text is matched only once.
    """
    pattern = _DIGEST if known else _TIGHT
    return F.split(F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$2|$3$4|$1")), r"\|", 3)


def digest_of(fields: Column, text: Column, known: bool = True) -> Column:
    """struct(algorithm, hex, bits, error) of the fields of a text; leading zeros count. known asks for one of the engine's algorithms."""
    algorithm, digits = F.nullif(F.get(fields, F.lit(2)), F.lit("")), F.get(fields, F.lit(1))
    side = F.get(fields, F.lit(0)).try_cast("bigint")
    error = (
        F.when(digits.isNull(), F.when(text.isNull() | (F.trim(text) == ""), "empty digest").when(text.contains(":"), "malformed serialized digest").otherwise("not hexadecimal"))
        .when(F.lit(known) & side.isNotNull() & ~F.coalesce(algorithm.isin(*PERCEPTUAL), F.lit(False)), "unknown algorithm")
        .when(F.length(digits) * 4 != side * side, "digest length does not fit its size")
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, algorithm).alias("algorithm"), F.when(ok, F.lower(digits)).alias("hex"), F.when(ok, F.length(digits) * 4).alias("bits"), error.alias("error")
    )


def digest_parts(text: Column) -> Column:
    """struct(algorithm, hex, bits, error) of a bare (optionally 0x) or algorithm:side:hex digest of a known algorithm."""
    return digest_of(digest_fields(text), text)


def words_of(hexed: Column) -> Column:
    """64-bit words (two's complement) of a hexadecimal text, the short one first; conv is only fed checked digits."""
    count = F.ceil(F.length(hexed) / 16).cast("int")
    padded = F.lpad(hexed, count * 16, "0")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.substring(padded, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))


def word_of(hexed: Column) -> Column:
    """The last 64 bits as one signed number; exact for hashes of at most 64 bits."""
    return F.conv(F.substring(F.lpad(hexed, 16, "0"), -16, 16), 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, d: acc + d)


def digest_distance(a: Column, b: Column) -> Column:
    """struct(distance, error) of two digest_parts(); widths must agree, and algorithms where both name one."""
    error = (
        F.when(a["error"].isNotNull() | b["error"].isNotNull(), "invalid digest")
        .when(a["algorithm"] != b["algorithm"], "algorithms differ")
        .when(a["bits"] != b["bits"], "widths differ")
    )
    return F.struct(F.when(error.isNull(), hamming(words_of(a["hex"]), words_of(b["hex"]))).alias("distance"), error.alias("error"))


def similarity(distance: Column, bits: Column) -> Column:
    """1 - distance / bits, at least 0; 0 for hashes without bits."""
    return F.when(bits <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - distance / bits))


def serialize_perceptual(algorithm: Column, side: Column, hexed: Column) -> Column:
    return F.concat_ws(":", algorithm, side.cast("string"), hexed)


def content_digest(content: Column, algorithm: str = "sha256") -> Column:
    """algorithm:hex of bytes or UTF-8 text; null stays null."""
    if algorithm not in CONTENT_LENGTHS:
        raise HashError(f"not a content hash algorithm: {algorithm}", operation="content_digest")
    return F.concat(F.lit(f"{algorithm}:"), F.md5(content) if algorithm == "md5" else F.sha2(content, 256))


def hasher_from_config(config: dict):
    """The function column -> digest that the setting hash_algorithm names (sha256 if unset); perceptual ones are refused."""
    algorithm = str(config.get("hash_algorithm") or "sha256").lower()
    if algorithm in PERCEPTUAL:
        raise HashError(f"{algorithm} hashes pictures, not contents", operation="hasher_from_config")
    if algorithm not in CONTENT_LENGTHS:
        raise HashError(f"not a content hash algorithm: {algorithm}", operation="hasher_from_config")
    return lambda content: content_digest(content, algorithm)


def is_similar(a: Column, b: Column, threshold: int) -> Column:
    """Whether two digest_parts() differ in at most threshold bits; null where they can't be compared."""
    if threshold < 0:
        raise HashError("the threshold must not be negative", operation="is_similar")
    return digest_distance(a, b)["distance"] <= threshold


def valid_content_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A(?:md5:[0-9a-f]{32}|sha256:[0-9a-f]{64})\z"), F.lit(False))


def cache_algorithm(algorithm: str, size: int | None = None) -> str:
    """The cache's name for a hasher: phash:8, content-sha256."""
    if algorithm in CONTENT_LENGTHS:
        return f"content-{algorithm}"
    check_perceptual(algorithm, size or 8)
    return f"{algorithm}:{size or 8}"


def check_perceptual(algorithm: str, size: int) -> None:
    """Only perceptual algorithms, sides of at least 2, and powers of two for the wavelet hash."""
    if algorithm not in PERCEPTUAL:
        raise HashError(f"not a perceptual hash algorithm: {algorithm}")
    if size < 2:
        raise HashError("hash size must be at least 2")
    if algorithm == "whash" and size & (size - 1):
        raise HashError("the wavelet hash needs a power of two")


def config_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
