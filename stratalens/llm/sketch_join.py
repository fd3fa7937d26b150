"""Near-duplicate records by a parity-sketch join.

A record is a set of tokens, hashed by XOR into a sketch of bits: token t flips bit h(t). The Hamming distance of two
sketches is at most the size of the symmetric difference of the sets. For a perceptual hash the tokens are its set bits
and h is one to one, so the sketch loses nothing and spreads neighbouring bits, which often agree, over all bands. For
other sets (near_sets) several tokens may share a bit; the sketch only finds candidates, and the sets are compared.

Sketches meet by the pigeonhole principle: cut into bound + t bands, two within the bound agree in t of them, and under
such a key they are compared in order of the sizes of their sets, so that only sizes within the bound of each other
(the size band of a record) are looked at. operators/bit_join.py says how keys stay small, whatever the data.

Equal hashes form a class, named by its smallest ident; only classes are compared. near_classes() gives the members
and the links between classes; near_pairs() expands them, as p5_found must list every pair.
"""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.hashing import digest_fields, digest_of
from stratalens.operators.bit_join import MOST, band_plan, close_codes, plain_bits, probes
from stratalens.operators.skew import lookup
from stratalens.work import Workspace


def parity_words(tokens: str, bits: int) -> Column:
    """The parity sketch of an array of tokens as 64-bit words: bit hash(t) % bits is flipped for every token t."""
    spots = F.transform(F.array_distinct(tokens), lambda t: F.pmod(F.xxhash64(t), F.lit(bits)))
    flip = lambda w: lambda acc, at: F.when(F.floor(at / 64) == w, acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")))).otherwise(acc)
    return F.array(*[F.aggregate(spots, F.lit(0).cast("bigint"), flip(w)) for w in range((bits + 63) // 64)])


# ---------------------------------------------------------------- sketches


def spots(bits: int) -> np.ndarray:
    """Which token (bit of the hash, highest first) flips each bit of the sketch: a one-to-one hash of the positions."""
    step = next(s for s in range(max(1, round(bits * 0.618)), 2 * bits + 2) if gcd(s, bits) == 1)
    return (np.arange(bits) * step) % bits


def sketch_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    """One line of bits per code: the parity sketch of its set bits."""
    return plain_bits(codes, bits)[:, spots(bits)]


def close_sketches(ws: Workspace, sketches: DataFrame, permille: int, joint: int | None = None, most: int = MOST) -> DataFrame:
    """(a, b, distance, many), a < b: different sketches of one space and width that differ in at most permille/1000 of the bits.

    sketches: a stored table (id, many, space, bits, code) without repeated (space, bits, code); the sketches are made
    from the codes where the keys are.
    """
    return close_codes(ws, sketches, lambda bits: bits * permille // 1000, sketch_bits, joint, most)


# ---------------------------------------------------------------- hashes


def parse_hashes(files: DataFrame, ident: str, text: str, space: str) -> DataFrame:
    """(ident, space, bits, code) of the rows with a valid hash, each once; code holds the bits as bytes.

    Valid are hexadecimal digits in any case, bare, after 0x, or as algorithm:side:hex with side squared bits; white
    space around doesn't count. Null, empty and malformed hashes and rows with a null id or space are left out.
    """
    # exploding one-element arrays keeps Spark from parsing again wherever a part is used
    rows = files.where(F.col(ident).isNotNull() & F.col(space).isNotNull()).select(F.col(ident).alias("ident"), F.col(space).cast("string").alias("space"), F.col(text).alias("text"), F.explode(F.array(digest_fields(F.col(text), known=False))).alias("f"))
    rows = rows.select("ident", "space", F.explode(F.array(digest_of(F.col("f"), F.col("text"), known=False))).alias("d")).where("d.error IS NULL")
    return rows.select("ident", "space", F.col("d.bits").alias("bits"), F.unhex("d.hex").alias("code")).distinct()


def near_classes(files: DataFrame, ident: str, text: str, space: str, permille: int = 100, joint: int | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, members, links): what is near what, without expanding copies.

    sketches (id, n, many, space, bits, code) are the distinct hashes, named by their smallest ident; members
    (id, ident) lists the idents of the hashes that several idents have; links (a, b, distance, many), a < b, are the
    pairs of different hashes within the bound, many telling whether one of them has several idents.
    """
    ws = Workspace(files.sparkSession, "sketches")
    rows = ws.save(parse_hashes(files, ident, text, space), "rows")
    counted = rows.groupBy("space", "bits", "code").agg(F.min("ident").alias("id"), F.count("*").alias("n"))
    sketches = ws.save(counted.select("id", "n", (F.col("n") > 1).alias("many"), "space", "bits", "code"), "sketches")
    # a much repeated hash is a hot key of rows, so it is looked up apart
    repeated = sketches.where("many").select("id", "space", "bits", "code")
    members = ws.save(lookup(rows, repeated, ["space", "bits", "code"], rows.count()).select("id", "ident"), "members")
    return sketches, members, ws.save(close_sketches(ws, sketches, permille, joint, most), "links")


def near_pairs(files: DataFrame, ident: str, text: str, space: str, permille: int = 100, joint: int | None = None, most: int = MOST) -> DataFrame:
    """(a, b, distance), a < b: all pairs of different idents of one space whose hashes are of one width and close enough.

    Expands near_classes(): links of hashes that one ident has are pairs already; the output grows with the square of
    the idents of one hash, as it lists them all.
    """
    _, members, links = near_classes(files, ident, text, space, permille, joint, most)
    plain = links.where("NOT many").select("a", "b", "distance")
    left = members.select(F.col("id").alias("a"), F.col("ident").alias("x"))
    right = members.select(F.col("id").alias("b"), F.col("ident").alias("y"))
    wide = links.where("many").join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "distance")
    equal = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y", F.lit(0).alias("distance"))
    both = wide.where("x <> y").unionByName(equal)
    return plain.unionByName(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance"))


# ---------------------------------------------------------------- sets of tokens


def near_sets(records: DataFrame, ident: str, tokens: str, permille: int = 100, bits: int = 256, joint: int | None = None, most: int = MOST) -> DataFrame:
    """(a, b, differing), a < b: pairs of different, non-empty sets that differ in at most permille/1000 of `bits` tokens.

    tokens is an array of strings; repeated and null tokens and their order don't count. Equal sets are represented by
    their smallest ident. The parity sketch finds the candidates, the sets themselves decide. Null idents are left out.
    """
    ws = Workspace(records.sparkSession, "sets")
    rows = records.select(F.col(ident).alias("ident"), F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("tokens")).where("ident IS NOT NULL AND size(tokens) > 0")
    # different sets with one sketch are candidates of each other, and share the sketch's other candidates
    sets = ws.save(rows.groupBy("tokens").agg(F.min("ident").alias("id")), "sets")
    words = parity_words("tokens", bits)
    code = F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))
    sketched = ws.save(sets.select("id", code.alias("code")), "sketched")
    counted = sketched.groupBy("code").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    sketches = ws.save(counted.select("id", (F.col("n") > 1).alias("many"), F.lit("").alias("space"), F.lit(bits).alias("bits"), "code"), "sketches")
    close = close_sketches(ws, sketches, permille, joint, most).select("a", "b")
    owners = sketched.join(sketches.select(F.col("id").alias("s"), "code"), "code").select("s", "id")
    left, right = owners.select(F.col("s").alias("a"), F.col("id").alias("x")), owners.select(F.col("s").alias("b"), F.col("id").alias("y"))
    pairs = close.join(left, "a").join(right, "b").select("x", "y").unionByName(left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y"))
    full = lambda side: sets.select(F.col("id").alias(side), F.col("tokens").alias(f"t{side}"))
    differing = F.size("tx") + F.size("ty") - 2 * F.size(F.array_intersect("tx", "ty"))
    both = pairs.join(full("x"), "x").join(full("y"), "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), differing.alias("differing"))
    return both.where(F.col("differing") <= bits * permille // 1000)
