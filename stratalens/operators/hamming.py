"""Near-duplicate hashes: an exact Hamming self-join, exact chains, components and numbered groups.

Hashes meet only within (space, width). Equal hashes are represented by their first file in input order, so a much
repeated hash is one row of the join; its files are linked as a chain, one edge per further file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.errors import DuplicateError
from stratalens.functions.hashing import digest_fields, digest_of, similarity
from stratalens.functions.text import path_key
from stratalens.operators.bit_join import close_codes
from stratalens.operators.stars import star_labels
from stratalens.work import Workspace

DEFAULT_THRESHOLD = 10
CONFIG_THRESHOLD = 8
SPACE = ["space", "bits"]


def check_threshold(threshold: int) -> None:
    if threshold < 0:
        raise DuplicateError("the distance threshold must not be negative", details={"threshold": threshold})


def parsed(files: DataFrame, path: str, text: str, space: str, order: str, strict: bool = True) -> DataFrame:
    """(ord, path, space, bits, code), the hash as bytes in code; strict raises on repeated paths and bad hashes, else bad hashes are left out."""
    # exploding one-element arrays keeps Spark from parsing again wherever a part is used
    rows = files.select(F.col(order).alias("ord"), F.col(path).alias("path"), F.col(space).alias("space"), F.col(text).alias("text"), F.explode(F.array(digest_fields(F.col(text)))).alias("f"))
    rows = rows.select("ord", "path", "space", F.explode(F.array(digest_of(F.col("f"), F.col("text")))).alias("d"))
    if strict:
        if twice := rows.groupBy("path").count().where("count > 1").first():
            raise DuplicateError("a path occurs twice in the input", file_path=twice["path"])
        if bad := rows.where(F.col("d.error").isNotNull()).first():
            raise DuplicateError(f"invalid hash: {bad['d']['error']}", file_path=bad["path"])
    return rows.where(F.col("d.error").isNull()).select("ord", "path", "space", F.col("d.bits").alias("bits"), F.unhex("d.hex").alias("code"))


def representatives(rows: DataFrame) -> DataFrame:
    """The first row of every distinct hash, in input order."""
    return rows.groupBy(*SPACE, "code").agg(F.min(F.struct("ord", "path")).alias("first")).select("first.ord", "first.path", *SPACE, "code")


def near_edges(reps: DataFrame, threshold: int) -> DataFrame:
    """(path_a, path_b, ord_a, ord_b, space, bits, distance) of different hashes within the threshold, earlier file first.

    ord must not repeat. Only ids and bits go through the join; the paths are looked up for the pairs found.
    """
    check_threshold(threshold)
    ws = Workspace(reps.sparkSession, "near")
    reps = ws.save(reps.select("ord", "path", *SPACE, "code").where("space IS NOT NULL"), "reps")
    codes = reps.select(F.col("ord").alias("id"), F.lit(False).alias("many"), F.col("space").cast("string").alias("space"), "bits", "code")
    close = ws.save(close_codes(ws, codes, lambda bits: threshold).select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"), "distance"), "close")
    a = reps.select(F.col("ord").alias("ord_a"), F.col("path").alias("path_a"), *SPACE)
    b = reps.select(F.col("ord").alias("ord_b"), F.col("path").alias("path_b"))
    return close.join(a, "ord_a").join(b, "ord_b").select("path_a", "path_b", "ord_a", "ord_b", *SPACE, "distance")


def exact_edges(rows: DataFrame) -> DataFrame:
    """One edge from each file of an equal hash to the next in input order; n files give n - 1.

    The files are cut into ranges of (hash, order), so a much repeated hash is spread over many tasks; each looks back
    within its range, and the first file of a range at the last one of the range before.
    """
    ws = Workspace(rows.sparkSession, "chain")
    order = [*SPACE, "code", "ord"]
    parts = ws.save(rows.select(*order, "path").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")
    here = F.struct(*order, "path")
    window = Window.partitionBy("part").orderBy(*order)
    # one row per range
    ends = parts.groupBy("part").agg(F.max(here).alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("part"))).select("part", "before")
    linked = parts.withColumn("prior", F.lag(here).over(window)).join(F.broadcast(ends), "part").withColumn("prior", F.coalesce("prior", "before"))
    same = F.lit(True)
    for c in (*SPACE, "code"):
        same = same & F.col(f"prior.{c}").eqNullSafe(F.col(c))
    linked = linked.where(F.col("prior").isNotNull() & same)
    return linked.select(F.col("prior.path").alias("path_a"), F.col("path").alias("path_b"), F.col("prior.ord").alias("ord_a"), F.col("ord").alias("ord_b"), *SPACE, F.lit(0).alias("distance"))


def edges(rows: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """All links with their similarity."""
    found = exact_edges(rows).unionByName(near_edges(representatives(rows), threshold))
    return found.withColumn("similarity", similarity(F.col("distance"), F.col("bits")))


def spread_labels(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v, label) with the smallest vertex linked to v, directly or not; vertices without links keep their own."""
    labels = star_labels(Workspace(vertices.sparkSession, "labels"), links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return vertices.join(labels.select(F.col("x").alias("v"), F.col("root").alias("label")), "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def duplicate_groups(files: DataFrame, path: str, text: str, space: str, order: str, threshold: int = DEFAULT_THRESHOLD, strict: bool = True) -> DataFrame:
    """(group_number, space, path, ord, n_files): members of all groups of at least two files.

    Groups are numbered over all spaces by falling size, then by their smallest path, compared component by component.
    """
    ws = Workspace(files.sparkSession, "groups")
    rows = ws.save(parsed(files, path, text, space, order, strict), "rows")
    links = edges(rows, threshold).select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b"))
    labels = spread_labels(rows.select(F.col("ord").alias("v")), links)
    members = rows.join(labels.select(F.col("v").alias("ord"), "label"), "ord").select("label", "space", "path", "ord")
    return numbered(members, "label", path_key(F.col("path")))


def numbered(members: DataFrame, label: str, key: Column) -> DataFrame:
    """Members of labelled groups of two and more, with the group's number and size instead of the label."""
    groups = members.groupBy(label).agg(F.count("*").alias("n_files"), F.min(F.struct(key.alias("k"), "path")).alias("least")).where("n_files >= 2")
    number = _running_number(groups, [F.col("n_files").desc(), F.col("least.path").asc()])
    return members.join(number.select(label, "group_number", "n_files"), label).drop(label)


def _running_number(df: DataFrame, order: list[Column]) -> DataFrame:
    """row_number over all rows without one task seeing them all: range partitions, counted, then offset."""
    spark = df.sparkSession
    ws = Workspace(spark, "numbers")
    parts = ws.save(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__part")), "parts")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row per partition
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__local", local).join(F.broadcast(before), "__part").withColumn("group_number", (F.col("__local") + F.col("__before")).cast("bigint")).drop("__part", "__local", "__before")


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """df with the place of every row among those of its key, from 1; keys must not be null.

    Row numbers run over range partitions of (key, order), so a key with a third of all rows is spread over many tasks.
    """
    numbered = _running_number(df, [*[F.col(k).asc() for k in keys], *order])
    first = numbered.groupBy(*keys).agg(F.min("group_number").alias("__first"))
    return numbered.join(first, keys).withColumn(name, F.col("group_number") - F.col("__first") + 1).drop("group_number", "__first")


def serialised(members: DataFrame, group: str, item: str, key: Column, size: int = 1000) -> DataFrame:
    """(group, part, n_files, files): the items of every group in order of key, in lists of at most `size`.

    Positions come from a running number over range partitions, so no group, however large, is gathered in one task.
    """
    rows = members.select(F.col(group).alias("group"), F.col(item).alias("item"), key.alias("k"))
    parts = positions(rows, ["group"], [F.col("k").asc()]).withColumn("part", F.floor((F.col("n") - 1) / size))
    lists = parts.groupBy("group", "part").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list(F.struct("n", "item"))).alias("s"))
    return lists.select(F.col("group").alias(group), "part", "n_files", F.transform("s", lambda s: s["item"]).alias("files"))
