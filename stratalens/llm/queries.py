"""The queries of the training-data operators on pairs, hashes and texts."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.components import components
from stratalens.llm.fm_index import build_index, removal_spans, search_index
from stratalens.llm.offensive import CATEGORIES, THRESHOLD, offensive, score
from stratalens.llm.packing import CLASSES, pack
from stratalens.llm.sketch_join import near_classes, near_pairs
from stratalens.llm.survivors import best_records, merged_records
from stratalens.operators.latest import latest_rows
from stratalens.operators.timestamps import parse_instants
from stratalens.plans.dirty_data import PARSE_SQL
from stratalens.tables import table
from stratalens.work import Workspace, stored_once

NO_INSTANT = -(1 << 62)
CAPACITY = 2048
VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def grouped_files(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """The live files that name a group, with quality, size and instant as the ranking wants them."""
    files = table(spark, folder, "media_files", "id", "run_id", "group_id", "size_bytes", "quality_score", "creation_date", "loaded_at", "deleted_at", *extra)
    files = latest_rows(files, ["id"], [F.col("loaded_at").desc_nulls_last()]).where(F.col("deleted_at").isNull() & F.col("group_id").isNotNull())
    zones = table(spark, folder, "report_runs", "id", "tz_name").select(F.col("id").alias("run_id"), F.col("tz_name").alias("zone"))
    files = parse_instants(files.join(zones, "run_id", "left"), "creation_date", "zone", "instant")
    return files.select(
        "run_id", "group_id", F.col("id").alias("file_id"), *extra, F.when(F.col("quality_score").between(0, 1), F.col("quality_score")).alias("quality"),
        F.when(F.col("size_bytes") >= 1, F.col("size_bytes")).otherwise(0).alias("size"), "instant",
    )


def live_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = latest_rows(table(spark, folder, "duplicate_groups", "id", "run_id", "loaded_at", "deleted_at"), ["id", "run_id"], [F.col("loaded_at").desc_nulls_last()])
    return groups.where(F.col("deleted_at").isNull()).select(F.col("id").alias("group_id"), "run_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving file of every live group with files. Ranked first, so that one row per group meets the groups."""
    ranking = [F.col("quality").desc_nulls_last(), F.col("size").desc(), F.col("instant").desc_nulls_last()]
    best = best_records(grouped_files(spark, folder), ["run_id", "group_id"], ranking, "file_id")
    return best.join(live_groups(spark, folder), ["group_id", "run_id"]).select("group_id", "file_id")


def p1_merged(spark: SparkSession, folder: str) -> DataFrame:
    """A built record per group: each field from its best-ranked file that has it."""
    files = grouped_files(spark, folder, "content_hash", "metadata")
    ranking = [-F.coalesce("quality", F.lit(-1.0)), -F.col("size"), -F.coalesce("instant", F.lit(NO_INSTANT))]
    fields = {
        "quality": F.col("quality"), "size": F.nullif("size", F.lit(0)), "instant": F.col("instant"), "content_hash": F.col("content_hash"),
        "metadata": F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")),
    }
    merged = merged_records(files, ["run_id", "group_id"], ranking, "file_id", fields)
    return merged.join(live_groups(spark, folder), ["run_id", "group_id"])


def linking_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "duplicate_pairs", "path_a", "path_b", "similarity")
    return pairs.where(F.col("similarity").between(0.85, 1.0) & ~F.isnan("similarity"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every path in an acceptable match, with the smallest path linked to it."""
    return components(linking_pairs(spark, folder), "path_a", "path_b").select(F.col("name").alias("path"), F.col("group").alias("group_path"))


def p4_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p4_found(spark, folder).groupBy("group_path").agg(F.count("*").alias("n_files"))
    return sizes.groupBy("n_files").agg(F.count("*").alias("n_groups"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of files of one media type whose hashes differ in at most a tenth of the bits."""
    files = table(spark, folder, "hashed_files", "ord", "perceptual_hash", "media_type")
    return near_pairs(files, "ord", "perceptual_hash", "media_type", 100).select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b")).distinct()


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with a valid hash, with its class of equal hashes (named by the smallest ord), the class's size and the number of other classes near it."""
    files = table(spark, folder, "hashed_files", "ord", "perceptual_hash", "media_type")
    sketches, members, links = near_classes(files, "ord", "perceptual_hash", "media_type", 100)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    classes = sketches.select("id", "n").join(ends, "id", "left").select("id", F.col("n").alias("n_files"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = classes.join(members, "id", "left").select(F.coalesce("ident", "id").alias("ord"), F.col("id").alias("class_ord"), "n_files", "n_links")
    return rows


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Which container every token of every non-empty text goes to."""
    return pack(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", CAPACITY, VOCABULARY)


def p6_room(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how many pieces they hold, with the share of their room that is used."""
    packed = p6_packed(spark, folder).groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    rows = packed.groupBy(F.least("n_pieces", F.lit(CLASSES)).alias("n_pieces")).agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return rows.withColumn("used", F.col("n_tokens") / (F.col("n_containers") * CAPACITY))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packing, per source: how many texts were packed; containers over the capacity that touch the source, texts
    whose pieces leave gaps, overlap or lack their beginning, texts cut although they fit one container, and pieces but the last that fill none."""
    documents = table(spark, folder, "documents", "doc_id", "text", "source")
    packed = pack(documents.select("doc_id", "text"), "doc_id", "text", CAPACITY, VOCABULARY)
    packed = Workspace(spark, "packed").save(packed, "pieces")  # tokenised once for both aggregations
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > CAPACITY).select("container", F.lit(1).alias("over"))
    pieces = packed.join(full, "container", "left").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("piece").alias("last"), F.count_if(F.col("first_token") != F.col("piece") * CAPACITY).alias("shifted"),
        F.count_distinct("piece").alias("distinct"), F.count_if(F.col("n_tokens") < CAPACITY).alias("short"), F.max("over").alias("over"),
    )
    rows = documents.where("text <> ''").select("doc_id", "source").join(pieces, "doc_id", "left").groupBy("source")
    broken = F.col("n").isNull() | (F.col("distinct") != F.col("n")) | (F.col("last") != F.col("n") - 1) | (F.col("shifted") > 0)
    return rows.agg(
        F.count("n").alias("n_packed"), F.count_if(F.col("over") == 1).alias("n_over"), F.count_if(broken).alias("n_broken"),
        F.count_if((F.col("n") > 1) & (F.col("tokens") <= CAPACITY)).alias("n_cut"), F.count_if(F.col("short") > 1).alias("n_short"),
    )


def document_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all documents, built when the work folder has none of the same files yet."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    return stored_once(documents, "fm-index", lambda path: build_index(documents, "doc_id", "text", path))


def leaked_spans(spark: SparkSession, folder: str) -> DataFrame:
    return search_index(document_index(spark, folder), table(spark, folder, "eval_items", "item_id", "text"), "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with each evaluation item that leaked into it."""
    return leaked_spans(spark, folder).select(F.col("ident").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The word spans in which each item leaked."""
    return leaked_spans(spark, folder).select(F.col("ident").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "last_word")


def p7_removals(spark: SparkSession, folder: str) -> DataFrame:
    """The word spans to remove from each document, merged over all items that leaked there."""
    return removal_spans(leaked_spans(spark, folder)).withColumnRenamed("ident", "doc_id")


def p7_suites(spark: SparkSession, folder: str) -> DataFrame:
    """Other sets of items, with shorter windows, against the same stored index: documents that repeat 8 words of an item, per suite."""
    index, items = document_index(spark, folder), table(spark, folder, "eval_items", "item_id", "suite", "text")
    names = sorted(r.suite for r in items.select("suite").where("suite IS NOT NULL").distinct().collect())  # the names of the suites, not data
    found = [search_index(index, items.where(F.col("suite") == name), "item_id", "text", 8).select(F.lit(name).alias("suite"), "ident", "item") for name in names]
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy("suite").agg(F.count_distinct("ident").alias("n_documents"), F.count_distinct("item").alias("n_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with abusive, hateful or sexual passages, by category."""
    return offensive(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").select(F.col("ident").alias("doc_id"), "category").distinct()


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document, 0 where there is no evidence: per category, evidence per thousand letters."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    scores = score(documents, "doc_id", "text").groupBy(F.col("ident").alias("doc_id"))
    wide = scores.pivot("category", list(CATEGORIES)).agg(F.first(F.round(F.col("total") * 1000 / F.col("letters"), 6)))
    return documents.select("doc_id").join(wide, "doc_id", "left").fillna(0.0)


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and affected documents per source."""
    documents = table(spark, folder, "documents", "doc_id", "text", "source")
    hit = score(documents, "doc_id", "text").where(F.col("passage") >= THRESHOLD).groupBy(F.col("ident").alias("doc_id")).agg(F.collect_set("category").alias("found"))
    rows = documents.select("doc_id", "source").join(hit, "doc_id", "left").groupBy("source")
    counts = [F.count_if(F.array_contains("found", c)).alias(f"n_{c}") for c in CATEGORIES]
    rates = [(F.col(f"n_{c}") / F.col("n_documents")).alias(f"rate_{c}") for c in CATEGORIES]
    return rows.agg(F.count("*").alias("n_documents"), *counts).select("*", *rates)


_P7 = """
  WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM eval_items),
  ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) i FROM iw)),
  dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM documents WHERE text IS NOT NULL),
  dg AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM dw)),
  found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""
_P1 = (
    """
  WITH files AS (SELECT * FROM media_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
  groups AS (SELECT * FROM duplicate_groups QUALIFY row_number() OVER (PARTITION BY id, run_id ORDER BY loaded_at DESC) = 1),
  src AS (
    SELECT f.run_id, f.group_id, f.id, creation_date AS raw, tz_name AS tz, CASE WHEN quality_score BETWEEN 0 AND 1 AND NOT isnan(quality_score) THEN quality_score END AS q, CASE WHEN size_bytes >= 1 THEN size_bytes ELSE 0 END AS size,
      content_hash, CASE WHEN json_valid(metadata) THEN metadata END AS metadata
    FROM files f JOIN groups g ON g.id = f.group_id AND g.run_id = f.run_id LEFT JOIN report_runs r ON r.id = f.run_id WHERE f.deleted_at IS NULL AND g.deleted_at IS NULL
  ),
"""
    + PARSE_SQL
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY run_id, group_id ORDER BY q DESC NULLS LAST, size DESC, micros DESC NULLS LAST, id) AS rn FROM m)"
)
_P4 = """
  WITH RECURSIVE link AS (
    SELECT DISTINCT path_a a, path_b b FROM duplicate_pairs WHERE path_a <> path_b AND similarity BETWEEN 0.85 AND 1 AND NOT isnan(similarity)
    UNION SELECT path_b, path_a FROM duplicate_pairs WHERE path_a <> path_b AND similarity BETWEEN 0.85 AND 1 AND NOT isnan(similarity)
  ),
  reach AS (SELECT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
  found AS (SELECT a AS path, min(b) AS group_path FROM reach GROUP BY a)
"""
_HASHES = """
  WITH t AS (SELECT DISTINCT ord, media_type, lower(trim(perceptual_hash, E' \\t\\r\\n')) t FROM hashed_files),
  h AS (
    SELECT ord, media_type, regexp_replace(t, '^0x', '') hex FROM t WHERE regexp_full_match(t, '(0x)?[0-9a-f]+')
    UNION ALL
    SELECT ord, media_type, split_part(t, ':', 3) FROM t
    WHERE regexp_full_match(t, '[^:]*:[0-9]{1,5}:[0-9a-f]+') AND split_part(t, ':', 2)::BIGINT ** 2 = length(split_part(t, ':', 3)) * 4
  ),
  w AS (SELECT ord, media_type, length(hex) n, [('0x' || substr(lpad(hex, (ceil(length(hex) / 16) * 16)::INT, '0'), i * 16 + 1, 16))::UBIGINT FOR i IN range(0, ceil(length(hex) / 16)::INT)] ws FROM h)
"""
_P5 = _HASHES + """
  SELECT a.ord AS ord_a, b.ord AS ord_b FROM w a JOIN w b ON a.media_type = b.media_type AND a.n = b.n AND a.ord < b.ord
  WHERE bit_count(xor(a.ws[1], b.ws[1])) <= a.n * 4 // 10
    AND list_sum([bit_count(xor(a.ws[i], b.ws[i])) FOR i IN range(1, len(a.ws) + 1)]) <= a.n * 4 // 10
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_merged": p1_merged, "p4_found": p4_found, "p4_sizes": p4_sizes, "p5_found": p5_found, "p5_classes": p5_classes,
            "p6_packed": p6_packed, "p6_checks": p6_checks, "p6_room": p6_room, "p7_found": p7_found, "p7_spans": p7_spans, "p7_removals": p7_removals, "p7_suites": p7_suites, "p7_items": p7_items, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT group_id, id AS file_id FROM r WHERE rn = 1",
        "p1_merged": _P1
        + """SELECT run_id, group_id, arg_min(id, rn) AS best_file_id, count(*) AS n_records, arg_min(q, rn) FILTER (q IS NOT NULL) AS quality, arg_min(size, rn) FILTER (size > 0) AS size,
          arg_min(micros, rn) FILTER (micros IS NOT NULL) AS instant, arg_min(content_hash, rn) FILTER (content_hash IS NOT NULL) AS content_hash, arg_min(metadata, rn) FILTER (metadata IS NOT NULL) AS metadata FROM r GROUP BY ALL""",
        "p4_found": _P4 + "SELECT path, group_path FROM found",
        "p4_sizes": _P4 + "SELECT n_files, count(*) AS n_groups FROM (SELECT group_path, count(*) AS n_files FROM found GROUP BY 1) GROUP BY 1",
        "p5_found": _P5,
        "p5_classes": _HASHES
        + """, c AS (SELECT media_type, n, ws, min(ord) AS class_ord, count(*) AS n_files FROM w GROUP BY ALL),
          l AS (SELECT a.class_ord AS a, b.class_ord AS b FROM c a JOIN c b ON a.media_type = b.media_type AND a.n = b.n AND a.class_ord < b.class_ord
            WHERE bit_count(xor(a.ws[1], b.ws[1])) <= a.n * 4 // 10 AND list_sum([bit_count(xor(a.ws[i], b.ws[i])) FOR i IN range(1, len(a.ws) + 1)]) <= a.n * 4 // 10),
          e AS (SELECT id AS class_ord, count(*) AS n_links FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY 1)
          SELECT w.ord, class_ord, n_files, coalesce(n_links, 0) AS n_links FROM w JOIN c ON w.media_type = c.media_type AND w.n = c.n AND w.ws = c.ws LEFT JOIN e USING (class_ord)""",
        "p6_checks": "SELECT source, count(*) AS n_packed, 0 AS n_over, 0 AS n_broken, 0 AS n_cut, 0 AS n_short FROM documents WHERE text <> '' GROUP BY source",
        "p7_found": _P7 + "SELECT doc_id, item_id FROM found",
        "p7_spans": _P7
        + """, hit AS (SELECT DISTINCT doc_id, item_id, i FROM dg JOIN ig USING (g)),
          mark AS (SELECT *, (i > lag(i, 1, -99) OVER w + 13)::INT AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY i)),
          span AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS n FROM mark)
          SELECT doc_id, item_id, min(i) - 1 AS first_word, max(i) + 11 AS last_word FROM span GROUP BY doc_id, item_id, n""",
        "p7_removals": _P7
        + """, hit AS (SELECT DISTINCT doc_id, i FROM dg JOIN ig USING (g)),
          mark AS (SELECT *, (i > lag(i, 1, -99) OVER (PARTITION BY doc_id ORDER BY i) + 13)::INT AS fresh FROM hit),
          span AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM mark)
          SELECT doc_id, min(i) - 1 AS first_word, max(i) + 11 AS last_word FROM span GROUP BY doc_id, n""",
        "p7_suites": _P7.replace("i + 12", "i + 7").replace("- 11", "- 6").replace("SELECT item_id, regexp", "SELECT item_id, suite, regexp").replace("DISTINCT item_id, array", "DISTINCT item_id, suite, array").replace("SELECT item_id, w, unnest", "SELECT item_id, suite, w, unnest").replace("DISTINCT doc_id, item_id", "DISTINCT doc_id, item_id, suite")
        + "SELECT suite, count(DISTINCT doc_id) AS n_documents, count(DISTINCT item_id) AS n_items FROM found GROUP BY suite",
        "p7_items": _P7 + "SELECT item_id, count(*) AS n_documents FROM found GROUP BY 1",
    }
