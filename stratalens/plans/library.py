"""Queries of the engine's own operators over the media library's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import dates, hashing, numbers, text
from stratalens.operators import cache, classify, hamming, inventory, live_photos, quality, report, saga, search
from stratalens.operators.latest import latest_rows
from stratalens.schemas import domain_violations
from stratalens.tables import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
NEAR = 5


#: Fixed values of the detectors in SQL, where @name stands for them.
_VALUES = {
    "@tools": ",".join(f"'{t}'" for t in classify.CAPTURE_TOOLS), "@ratios": ", ".join(f"{a}/{b}" for a, b in classify.DISPLAY_RATIOS),
    "@generators": ",".join(f"'{g}'" for g in sorted(classify.GENERATORS)), "@names": "|".join(classify.SCREENSHOT_NAMES),
}


def query(sql: str | None = None):
    def register(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = re.sub("|".join(_VALUES), lambda m: _VALUES[m[0]], sql)
        return function

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def latest_files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = table(spark, folder, "media_files", *dict.fromkeys(["id", "loaded_at", *columns]))
    return latest_rows(rows, ["id"], [F.col("loaded_at").desc_nulls_last()])


FILES = "files AS (SELECT * FROM media_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"

# ---------------------------------------------------------------- exact duplicates and digests


@query("""
  WITH d AS (SELECT doc_id, n_chars, sha256(text) AS digest FROM documents WHERE text IS NOT NULL),
  g AS (SELECT digest, count(*) AS n_docs, min(doc_id) AS first_doc, sum(n_chars)::BIGINT AS total_chars FROM d GROUP BY digest HAVING count(*) >= 2),
  b AS (SELECT digest, doc_id AS best_doc FROM d QUALIFY row_number() OVER (PARTITION BY digest ORDER BY n_chars DESC, doc_id) = 1)
  SELECT row_number() OVER (ORDER BY n_docs DESC, first_doc) AS group_number, digest, n_docs, first_doc, best_doc, total_chars FROM g JOIN b USING (digest)
""")
def exact_dup_groups(spark, folder):
    """Groups of equal texts, numbered by falling size, with the copy to keep. Aggregates combine before their only shuffle."""
    docs = table(spark, folder, "documents", "doc_id", "text", "n_chars").where(F.col("text").isNotNull())
    docs = docs.select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").alias("doc_id")))["doc_id"]
    groups = docs.groupBy("digest").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), best.alias("best_doc"), F.sum("n_chars").alias("total_chars")).where("n_docs >= 2")
    return hamming._running_number(groups, [F.col("n_docs").desc(), F.col("first_doc").asc()]).select("group_number", "digest", "n_docs", "first_doc", "best_doc", "total_chars")


@query("SELECT doc_id, 'md5:' || md5(text) AS md5_digest, 'sha256:' || sha256(text) AS sha_digest, text IS NOT NULL AS valid FROM documents")
def content_digests(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", hashing.content_digest(F.col("text"), "md5").alias("md5_digest"), hashing.content_digest(F.col("text")).alias("sha_digest")).withColumn("valid", hashing.valid_content_digest(F.col("sha_digest")))


_DIGESTS = """
  t AS (SELECT DISTINCT ord, path, media_type, trim(perceptual_hash, E' \\t\\r\\n') AS t FROM hashed_files),
  p AS (
    SELECT ord, path, media_type, t, contains(t, ':') AS serial, split_part(t, ':', 1) AS alg, try_cast(split_part(t, ':', 2) AS BIGINT) AS side, split_part(t, ':', 3) AS sx, regexp_replace(t, '^0[xX]', '') AS bare FROM t
  ),
  digests AS (
    SELECT ord, path, media_type,
      CASE WHEN t IS NULL OR t = '' THEN NULL WHEN serial THEN CASE WHEN regexp_full_match(sx, '[0-9a-fA-F]+') AND length(sx) * 4 = side * side THEN lower(sx) END WHEN regexp_full_match(bare, '[0-9a-fA-F]+') THEN lower(bare) END AS hex,
      CASE WHEN serial THEN alg END AS algorithm
    FROM p
  )
"""


@query("WITH " + _DIGESTS + "SELECT ord, CASE WHEN hex IS NOT NULL THEN algorithm END AS algorithm, hex, (length(hex) * 4)::INT AS bits FROM digests")
def digest_parse(spark, folder):
    files = table(spark, folder, "hashed_files", "ord", "path", "perceptual_hash", "media_type").distinct()
    return files.select("ord", hashing.digest_parts(F.col("perceptual_hash")).alias("d")).select("ord", "d.algorithm", "d.hex", "d.bits")


@query("WITH " + _DIGESTS + "SELECT length(hex) * 4 AS bits, count(*) AS n, sum(bit_count(('0x' || right(lpad(hex, 16, '0'), 16))::UBIGINT))::BIGINT AS ones FROM digests WHERE hex IS NOT NULL GROUP BY 1")
def hash_word_aggregate(spark, folder):
    """How many bits the last words of the hashes have set, per width."""
    files = table(spark, folder, "hashed_files", "ord", "path", "perceptual_hash", "media_type").distinct()
    d = files.select(hashing.digest_parts(F.col("perceptual_hash")).alias("d")).where("d.hex IS NOT NULL")
    return d.groupBy(F.col("d.bits").cast("bigint").alias("bits")).agg(F.count("*").alias("n"), F.sum(F.bit_count(hashing.word_of(F.col("d.hex")))).alias("ones"))


@query("""
  WITH m AS (SELECT vec_id, embedding, list_sum([x::DOUBLE FOR x IN embedding]) / len(embedding) AS mean FROM embeddings),
  w AS (SELECT vec_id, list_sum([CASE WHEN embedding[i] > mean THEN (2::HUGEINT ** (64 - i))::HUGEINT ELSE 0::HUGEINT END FOR i IN range(1, 65)]) AS word FROM m)
  SELECT vec_id, lower(lpad(hex(word::UBIGINT), 16, '0')) AS hash FROM w
""")
def vector_hashes(spark, folder):
    """A 64-bit hash of each 64-wide vector: a bit is set where the value exceeds the mean."""
    mean = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v) / F.size("embedding")
    bits = F.array_join(F.transform("embedding", lambda v: F.when(v > F.col("mean"), "1").otherwise("0")), "")
    return table(spark, folder, "embeddings", "vec_id", "embedding").withColumn("mean", mean).select("vec_id", F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0")).alias("hash"))


# ---------------------------------------------------------------- similarity join, components, groups

_WORDS = _DIGESTS + """,
  h AS (SELECT ord, path, media_type, length(hex) * 4 AS bits, hex, [('0x' || substr(lpad(hex, (ceil(length(hex) / 16) * 16)::INT, '0'), i * 16 + 1, 16))::UBIGINT FOR i IN range(0, ceil(length(hex) / 16)::INT)] AS ws FROM digests WHERE hex IS NOT NULL),
  reps AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY media_type, bits, hex ORDER BY ord) = 1),
  near AS (
    SELECT a.path AS path_a, b.path AS path_b, a.ord AS ord_a, b.ord AS ord_b, a.bits, list_sum([bit_count(xor(a.ws[i], b.ws[i])) FOR i IN range(1, len(a.ws) + 1)]) AS distance
    FROM reps a JOIN reps b ON a.media_type = b.media_type AND a.bits = b.bits AND a.ord < b.ord
    WHERE bit_count(xor(a.ws[1], b.ws[1])) <= 5
  ),
  chain AS (SELECT lag(path) OVER w AS path_a, path AS path_b, lag(ord) OVER w AS ord_a, ord AS ord_b, bits, 0 AS distance FROM h WINDOW w AS (PARTITION BY media_type, bits, hex ORDER BY ord))
"""


def _hashes(spark, folder):
    files = table(spark, folder, "hashed_files", "ord", "path", "perceptual_hash", "media_type").distinct()
    return hamming.parsed(files, "path", "perceptual_hash", "media_type", "ord", strict=False)


@query("WITH " + _WORDS + "SELECT path_a, path_b, distance::INT AS distance, greatest(0.0::DOUBLE, 1.0::DOUBLE - distance / bits) AS similarity FROM near WHERE distance <= 5")
def hamming_pairs_banded(spark, folder):
    """Pairs of representatives within the distance, found by pigeonhole bands."""
    found = hamming.near_edges(hamming.representatives(_hashes(spark, folder)), NEAR)
    return found.select("path_a", "path_b", "distance", hashing.similarity(F.col("distance"), F.col("bits")).alias("similarity"))


@query("WITH " + _WORDS + "SELECT path_a, path_b FROM chain WHERE ord_a IS NOT NULL")
def exact_dup_chain(spark, folder):
    return hamming.exact_edges(_hashes(spark, folder)).select("path_a", "path_b")


@query("WITH " + _WORDS + "SELECT count(*) AS n FROM near WHERE distance <= 0")
def hamming_threshold_zero(spark, folder):
    """A distance of zero finds no near pairs: equal hashes are chained, not paired."""
    return hamming.near_edges(hamming.representatives(_hashes(spark, folder)), 0).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_pairs FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def hamming_threshold_all(spark, folder):
    """A threshold as wide as the hash pairs all different hashes: each found pair counts for all files of both hashes, and equal ones pair among themselves."""
    rows = vector_hashes(spark, folder).select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("path"), "hash", F.lit("v").alias("space"))
    rows = hamming.parsed(rows, "path", "hash", "space", "ord", strict=False)
    counted = rows.groupBy(*hamming.SPACE, "code").agg(F.min("ord").alias("ord"), F.count("*").alias("m"))
    # the join hands paths through; the counts travel in their place
    found = hamming.near_edges(counted.withColumnRenamed("m", "path"), 64)
    across = found.agg(F.coalesce(F.sum(F.col("path_a") * F.col("path_b")), F.lit(0)).alias("n"))
    within = counted.agg(F.coalesce(F.sum(F.expr("m * (m - 1) div 2")), F.lit(0)).alias("w"))
    return across.crossJoin(within).select((F.col("n") + F.col("w")).cast("bigint").alias("n_pairs"))


_GROUPS = _WORDS + """,
  link AS (
    SELECT ord_a AS a, ord_b AS b FROM near WHERE distance <= 5 UNION SELECT ord_b, ord_a FROM near WHERE distance <= 5
    UNION SELECT ord_a, ord_b FROM chain WHERE ord_a IS NOT NULL UNION SELECT ord_b, ord_a FROM chain WHERE ord_a IS NOT NULL
  ),
  reach AS (SELECT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
  label AS (SELECT a AS ord, min(b) AS label FROM reach GROUP BY a),
  members AS (SELECT h.path, h.media_type, l.label FROM h JOIN label l USING (ord)),
  sized AS (SELECT label, count(*) AS n_files, min(string_split(path, '/')) AS k FROM members GROUP BY label),
  numbered AS (SELECT label, n_files, row_number() OVER (ORDER BY n_files DESC, array_to_string(k, '/')) AS group_number FROM sized)
"""


@query("WITH RECURSIVE " + _GROUPS + "SELECT n.group_number, m.media_type AS space, m.path, n.n_files FROM members m JOIN numbered n USING (label)")
def dup_groups_numbered(spark, folder):
    """Members of the near-duplicate groups with the group's number."""
    files = table(spark, folder, "hashed_files", "ord", "path", "perceptual_hash", "media_type").distinct()
    return hamming.duplicate_groups(files, "path", "perceptual_hash", "media_type", "ord", NEAR, strict=False).select("group_number", "space", "path", "n_files")


@query("WITH RECURSIVE " + _GROUPS + "SELECT n_files, count(*) AS n_groups FROM sized GROUP BY n_files")
def dup_components(spark, folder):
    groups = dup_groups_numbered(spark, folder).select("group_number", "n_files").distinct()
    return groups.groupBy("n_files").agg(F.count("*").alias("n_groups"))


# ---------------------------------------------------------------- quality

_QUALITY = f"""
  WITH {FILES}, meta AS (SELECT file_id, max(width) AS width, max(height) AS height, max(bitrate) AS bitrate FROM media_metadata GROUP BY file_id),
  m AS (
    SELECT run_id, group_id, path, id, (coalesce(width, 0) * coalesce(height, 0))::BIGINT AS resolution, coalesce(size_bytes, 0) AS file_size, 0.0::DOUBLE AS sharpness, coalesce(bitrate, 0) AS bitrate
    FROM files LEFT JOIN meta ON file_id = id WHERE group_id IS NOT NULL
  ),
  x AS (SELECT *, max(resolution) OVER g AS xr, max(file_size) OVER g AS xs, max(bitrate) OVER g AS xb FROM m WINDOW g AS (PARTITION BY run_id, group_id)),
  c AS (
    SELECT *, (1.0::DOUBLE * CASE WHEN xr > 0 THEN resolution / xr ELSE 0.0 END + 1.0::DOUBLE * CASE WHEN xs > 0 THEN file_size / xs ELSE 0.0 END + 0.0::DOUBLE + 1.0::DOUBLE * CASE WHEN xb > 0 THEN bitrate / xb ELSE 0.0 END) / 4.0::DOUBLE AS composite FROM x
  ),
  r AS (SELECT *, row_number() OVER (PARTITION BY run_id, group_id ORDER BY composite DESC, resolution DESC, file_size DESC, path) AS rank FROM c)
"""


def _ranked(spark, folder):
    files = latest_files(spark, folder, "run_id", "group_id", "path", "size_bytes", "media_type").where(F.col("group_id").isNotNull())
    meta = table(spark, folder, "media_metadata", "file_id", "width", "height", "bitrate").groupBy(F.col("file_id").alias("id")).agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("bitrate").alias("rate"))
    rows = files.join(meta, "id", "left")
    return quality.ranked(rows.select("run_id", "group_id", "path", "id", *quality.metrics(F.col("width"), F.col("height"), F.col("size_bytes"), F.col("rate"), F.col("media_type"))), ["run_id", "group_id"], "path")


@query(_QUALITY + "SELECT run_id, group_id, path, composite, rank::INT AS rank FROM r")
def quality_rank(spark, folder):
    return _ranked(spark, folder).select("run_id", "group_id", "path", "composite", "rank")


@query(_QUALITY + "SELECT run_id, group_id, path AS target_path FROM r WHERE rank = 1")
def quality_best(spark, folder):
    return quality.best(_ranked(spark, folder)).select("run_id", "group_id", F.col("path").alias("target_path"))


# ---------------------------------------------------------------- the hash cache

_CACHE = f"""
  WITH {FILES},
  entries AS (SELECT path, 'content-sha256' AS algorithm, epoch_us(loaded_at) / 1e6 AS mtime, size_bytes AS size, content_hash AS hash, loaded_at FROM media_files WHERE content_hash IS NOT NULL),
  cache AS (SELECT path, algorithm, mtime, size, hash FROM entries QUALIFY row_number() OVER (PARTITION BY path, algorithm ORDER BY loaded_at, hash, size) = 1),
  wanted AS (SELECT path, 'content-sha256' AS algorithm, epoch_us(loaded_at) / 1e6 AS mtime, size_bytes AS size FROM files),
  looked AS (SELECT w.*, CASE WHEN regexp_full_match(c.hash, 'md5:[0-9a-f]{{32}}|sha256:[0-9a-f]{{64}}') THEN c.hash END AS hash FROM wanted w LEFT JOIN cache c ON c.path = w.path AND c.algorithm = w.algorithm AND c.mtime = w.mtime AND c.size = w.size)
"""


def _cache(spark, folder):
    """(cache of the first deliveries, wanted keys of the latest ones)."""
    rows = table(spark, folder, "media_files", "path", "loaded_at", "size_bytes", "content_hash").where(F.col("content_hash").isNotNull())
    entry = [F.col("path"), F.lit("content-sha256").alias("algorithm"), (F.unix_micros("loaded_at") / 1e6).alias("mtime"), F.col("size_bytes").alias("size")]
    first = latest_rows(rows, ["path"], [F.col("loaded_at").asc(), F.col("content_hash").asc(), F.col("size_bytes").asc()])
    return first.select(*entry, F.col("content_hash").alias("hash")), latest_files(spark, folder, "path", "size_bytes").select(*entry)


@query(_CACHE + "SELECT path, hash FROM looked WHERE hash IS NOT NULL")
def cache_lookup_hits(spark, folder):
    stored, wanted = _cache(spark, folder)
    return cache.lookup(wanted, stored, hashing.valid_content_digest(F.col("hash"))).where("hit").select("path", "hash")


@query(_CACHE + "SELECT path, mtime, size FROM looked WHERE hash IS NULL")
def cache_lookup_misses(spark, folder):
    stored, wanted = _cache(spark, folder)
    return cache.lookup(wanted, stored, hashing.valid_content_digest(F.col("hash"))).where("NOT hit").select("path", "mtime", "size")


@query(_CACHE + ", up AS (SELECT path, algorithm, mtime, size, coalesce(hash, 'sha256:' || sha256(path)) AS hash FROM looked) SELECT path, algorithm, mtime, size, hash FROM up UNION ALL SELECT path, algorithm, mtime, size, hash FROM cache WHERE path NOT IN (SELECT path FROM up)")
def cache_upsert_latest(spark, folder):
    """The cache after the misses were hashed (here: the path's digest) and all outcomes written back."""
    stored, wanted = _cache(spark, folder)
    looked = cache.lookup(wanted, stored, hashing.valid_content_digest(F.col("hash")))
    fresh = looked.select("path", "algorithm", "mtime", "size", F.coalesce("hash", hashing.content_digest(F.col("path"))).alias("hash"), F.lit(1).alias("ord"))
    return cache.upsert(stored, fresh)


@query(_CACHE + "SELECT path FROM cache WHERE path NOT IN (SELECT path FROM files WHERE deleted_at IS NULL)")
def cache_stale(spark, folder):
    stored, _ = _cache(spark, folder)
    return cache.stale(stored, latest_files(spark, folder, "path", "deleted_at").where("deleted_at IS NULL")).select("path")


@query(_CACHE + "SELECT path, hash FROM cache WHERE path IN (SELECT path FROM files WHERE deleted_at IS NULL)")
def cache_prune(spark, folder):
    stored, _ = _cache(spark, folder)
    return cache.prune(stored, latest_files(spark, folder, "path", "deleted_at").where("deleted_at IS NULL")).select("path", "hash")


@query(_CACHE + "SELECT (SELECT count(*) FROM cache) AS entries, (SELECT count(DISTINCT path) FROM cache) AS paths, count(hash) AS hits, count(*) - count(hash) AS misses, CASE WHEN count(*) > 0 THEN count(hash) / count(*) ELSE 0.0 END AS hit_rate FROM looked")
def cache_stats(spark, folder):
    stored, wanted = _cache(spark, folder)
    return cache.stats(cache.lookup(wanted, stored, hashing.valid_content_digest(F.col("hash"))), stored)


# ---------------------------------------------------------------- inventory and filters

_REL = "rel AS (SELECT id, ltrim(path, '/') AS rel, path FROM files)"


def _rel(spark, folder):
    return latest_files(spark, folder, "path").select("id", F.ltrim("path", F.lit("/")).alias("rel"), "path")


@query(f"WITH {FILES} SELECT count(*) AS n_files, sum(size_bytes)::BIGINT AS total_bytes, (SELECT '{{' || string_agg('\"' || t || '\":' || n, ',' ORDER BY t) || '}}' FROM (SELECT media_type AS t, count(*) AS n FROM files GROUP BY 1)) AS counts_by_type, 0::BIGINT AS n_unknown, epoch_us(min(loaded_at)) AS oldest, epoch_us(max(loaded_at)) AS newest FROM files")
def inventory_stats(spark, folder):
    stats = inventory.directory_stats(latest_files(spark, folder, "media_type", "size_bytes"), "media_type", "size_bytes", F.col("loaded_at"))
    return stats.withColumns({"counts_by_type": F.to_json("counts_by_type"), "oldest": F.unix_micros("oldest"), "newest": F.unix_micros("newest")})


@query(f"WITH {FILES}, {_REL} SELECT id FROM rel WHERE NOT (regexp_matches(rel, '(^|/)IMG_[^/]*\\.jpg$') OR regexp_matches(rel, '^.*/2021/.*$') OR regexp_matches(rel, '(^|/)[a-c][^/]*-1[0-9](/|$)'))")
def filter_globs(spark, folder):
    rows = _rel(spark, folder)
    return rows.where(~inventory.excluded(F.col("rel"), ["IMG_*.jpg", "*/2021/*", "[a-c]*-1[0-9]"])).select("id")


@query(f"WITH {FILES}, {_REL} SELECT id, (len(string_split(rel, '/')) - 1)::INT AS depth FROM rel WHERE len(string_split(rel, '/')) - 1 <= 4")
def filter_depth(spark, folder):
    return _rel(spark, folder).select("id", inventory.depth(F.col("rel")).alias("depth")).where("depth <= 4")


@query(f"WITH {FILES}, {_REL} SELECT count(*) AS n_visible FROM rel WHERE NOT regexp_matches(rel, '(^|/)\\.')")
def filter_hidden(spark, folder):
    return _rel(spark, folder).where(~inventory.hidden(F.col("rel"))).agg(F.count("*").alias("n_visible"))


@query(f"WITH {FILES}, x AS (SELECT id, CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '\\.([^.]+)$', 1)) ELSE lower(filename) END AS extension FROM files) SELECT extension, count(*) AS n FROM x GROUP BY 1")
def extension_normalize(spark, folder):
    rows = latest_files(spark, folder, "filename").select(text.normalize_extension(F.col("filename")).alias("extension"))
    return rows.groupBy("extension").agg(F.count("*").alias("n"))


@query(f"""
  WITH {FILES}, x AS (SELECT lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS e FROM files)
  SELECT CASE WHEN e IN ('jpg','jpeg','png','webp','heic','tiff','tif','gif','bmp') THEN 'image' WHEN e IN ('mp4','mov','mkv','avi','webm','m4v') THEN 'video' WHEN e IN ('mp3','wav','flac','aac','m4a','ogg','opus') THEN 'audio' END AS by_name, count(*) AS n FROM x GROUP BY 1
""")  # fmt: skip
def type_lookup(spark, folder):
    kind = text.media_type(text.normalize_extension(F.col("filename")), overrides={"ogg": "audio", "m4v": "video"})
    return latest_files(spark, folder, "filename").groupBy(kind.alias("by_name")).agg(F.count("*").alias("n"))


@query(f"""
  WITH {FILES}, {_REL},
  p AS (SELECT deleted_at, string_split(regexp_extract(rel, '^(.*)/[^/]*$', 1), '/') AS parts FROM rel JOIN files USING (id) WHERE contains(rel, '/')),
  a AS (SELECT deleted_at, unnest([array_to_string(parts[1:i], '/') FOR i IN range(1, len(parts) + 1)]) AS rel FROM p),
  held AS (SELECT DISTINCT rel FROM a WHERE deleted_at IS NULL)
  SELECT DISTINCT rel FROM a ANTI JOIN held USING (rel)
""")
def empty_dirs_all(spark, folder):
    """Directories of the library that hold no files any more, in or below them: all files known there were deleted."""
    rows = latest_files(spark, folder, "path", "deleted_at").withColumn("rel", F.ltrim("path", F.lit("/"))).where(F.col("rel").contains("/"))
    rows = rows.select(text.parent(F.col("rel")).alias("dir"), F.col("deleted_at").isNull().alias("kept"))
    holding = rows.groupBy("dir").agg(F.max("kept").alias("has_files"))
    dirs = holding.select(F.explode(inventory.prefixes(F.col("dir"))).alias("rel")).distinct()
    dirs = dirs.join(holding.withColumnRenamed("dir", "rel"), "rel", "left").select("rel", F.coalesce("has_files", F.lit(False)).alias("has_files"), F.lit(False).alias("is_symlink"))
    return inventory.empty_directories(dirs)


# ---------------------------------------------------------------- classification and routing

_SIGNALS = f"""
  WITH {FILES},
  j AS (SELECT id, filename, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM files),
  s AS (SELECT id, filename, try_cast(json_extract_string(m, '$.width') AS BIGINT) AS w, try_cast(json_extract_string(m, '$.height') AS BIGINT) AS h, lower(json_extract_string(m, '$.software')) AS sw FROM j),
  g AS (
    SELECT id, filename, sw, w, h, regexp_matches(filename, '(?i)@names') AS n,
      coalesce(list_bool_or([contains(sw, t) FOR t IN [@tools]]), false) AS t,
      coalesce(w > 0 AND h > 0 AND least(w, h) >= 720 AND list_bool_or([abs(greatest(w, h) / nullif(least(w, h), 0) - r) <= r * 0.01 FOR r IN [@ratios]]), false) AS d
    FROM s
  ),
  c AS (SELECT *, least(1.0::DOUBLE, CASE WHEN n THEN 0.6::DOUBLE ELSE 0.0 END + CASE WHEN t THEN 0.8::DOUBLE ELSE 0.0 END + CASE WHEN d THEN 0.3::DOUBLE ELSE 0.0 END) AS confidence FROM g)
"""


def _signals(spark, folder):
    kind = "width string, height string, software string"
    files = latest_files(spark, folder, "filename", "metadata")
    m = F.when(F.try_parse_json("metadata").isNotNull(), F.from_json("metadata", kind))
    rows = files.select("id", "filename", m.alias("m")).select("id", "filename", F.col("m.width").try_cast("bigint").alias("w"), F.col("m.height").try_cast("bigint").alias("h"), F.col("m.software").alias("software"))
    return rows.withColumn("shot", classify.screenshot(F.col("filename"), F.col("software"), F.col("w"), F.col("h")))


@query(_SIGNALS + "SELECT id, confidence >= 0.5 AS is_screenshot, confidence, n AS by_name, t AS by_software, d AS by_size FROM c")
def screenshot_score(spark, folder):
    return _signals(spark, folder).select("id", "shot.*")


@query("""
  WITH t AS (SELECT doc_id, lower(text) AS t, source FROM documents),
  m AS (SELECT doc_id, [x FOR x IN [@generators] IF contains(coalesce(t, ''), x)][1] AS marker, CASE WHEN source = 'screenshot_text' THEN 'prompt' END AS chunk FROM t),
  c AS (SELECT doc_id, marker, CASE WHEN chunk IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0 END + CASE WHEN marker IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0 END AS raw FROM m)
  SELECT doc_id, marker, least(1.0::DOUBLE, raw) >= 0.5 AS is_ai_generated, least(1.0::DOUBLE, raw) AS confidence FROM c
""")
def ai_score(spark, folder):
    """Generator names in texts, and the prompt chunk (here: texts of one source stand for it)."""
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    chunks = F.when(F.col("source") == "screenshot_text", F.create_map(F.lit("prompt"), F.col("source")))
    rows = docs.select("doc_id", classify.generator_marker(F.col("text")).alias("marker"), classify.prompt_key(chunks).alias("key"))
    return rows.select("doc_id", "marker", classify.ai_generated(F.lit(False), F.col("key"), F.col("marker")).alias("ai")).select("doc_id", "marker", "ai.*")


_GRAPHIC = """
  WITH m AS (SELECT file_id, max(image_format) AS f, bool_or(has_alpha) AS alpha, max(bit_depth) AS depth, bool_or(image_format = 'JPEG') AS camera FROM media_metadata GROUP BY file_id),
  s AS (SELECT file_id, coalesce(camera, false) AS camera, coalesce(alpha, false) AS alpha, CASE WHEN depth <= 8 THEN 'graphic' WHEN depth IS NOT NULL THEN 'photo' END AS side FROM m),
  p AS (SELECT *, CASE WHEN camera THEN 0.7::DOUBLE ELSE 0.0 END + CASE WHEN side = 'photo' THEN 0.5::DOUBLE ELSE 0.0 END AS photo, CASE WHEN alpha THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN side = 'graphic' THEN 0.5::DOUBLE ELSE 0.0 END AS graphic FROM s),
  pg AS (SELECT file_id, CASE WHEN photo + graphic = 0 THEN 'unknown' WHEN photo >= graphic THEN 'photo' ELSE 'graphic' END AS content_type, CASE WHEN photo + graphic = 0 THEN 0.0::DOUBLE ELSE greatest(photo, graphic) / (photo + graphic) END AS confidence FROM p)
"""


def _graphics(spark, folder):
    meta = table(spark, folder, "media_metadata", "file_id", "image_format", "has_alpha", "bit_depth").groupBy("file_id")
    meta = meta.agg(F.max("has_alpha").alias("alpha"), F.max("bit_depth").alias("depth"), F.max(F.col("image_format") == "JPEG").alias("camera"))
    side = classify.histogram_side(F.when(F.col("depth") <= 8, 1).when(F.col("depth").isNotNull(), 1 << 20), F.lit(0.0), F.lit(False))
    return meta.select("file_id", classify.photo_graphic(F.col("camera"), F.col("alpha"), side).alias("pg"))


@query(_GRAPHIC + "SELECT file_id, content_type, confidence FROM pg")
def photo_graphic_score(spark, folder):
    return _graphics(spark, folder).select("file_id", "pg.*")


@query("WITH s AS (SELECT file_id, max(width) AS w, max(height) AS h FROM media_metadata GROUP BY 1) SELECT file_id, coalesce(w > 0 AND h > 0 AND least(w, h) >= 720 AND list_bool_or([abs(greatest(w, h) / nullif(least(w, h), 0) - r) <= r * 0.01 FOR r IN [@ratios]]), false) AS screen_like FROM s")
def aspect_ratio_match(spark, folder):
    sizes = table(spark, folder, "media_metadata", "file_id", "width", "height").groupBy("file_id").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    return sizes.select("file_id", classify.screen_size(F.col("w"), F.col("h")).alias("screen_like"))


_ROUTE = _SIGNALS + "," + _GRAPHIC.replace("WITH m AS", "mm AS").replace("FROM m)", "FROM mm)").replace("s AS (SELECT file_id", "ss AS (SELECT file_id").replace("FROM s)", "FROM ss)") + """,
  r AS (
    SELECT c.id, CASE WHEN c.confidence >= 0.75 THEN 'screenshot' WHEN pg.content_type = 'graphic' AND pg.confidence >= 0.75 THEN 'graphic' WHEN c.confidence >= 0.5 OR pg.content_type = 'graphic' THEN 'review' END AS category
    FROM c LEFT JOIN pg ON pg.file_id = c.id
  )
"""


def _routed(spark, folder):
    rows = _signals(spark, folder).join(_graphics(spark, folder).withColumnRenamed("file_id", "id"), "id", "left")
    ai = F.struct(F.lit(False).alias("is_ai_generated"), F.lit(0.0).alias("confidence"))
    return rows.select("id", classify.route(F.lit(False), ai, F.col("shot"), F.col("pg")).alias("category"))


@query(_ROUTE + "SELECT id, category FROM r")
def route_resolution(spark, folder):
    return _routed(spark, folder)


@query(_ROUTE + "SELECT id, CASE category WHEN 'screenshot' THEN 'Screenshots/2024/05' WHEN 'graphic' THEN 'Graphics/2024/05' WHEN 'review' THEN 'Review/2024/05' ELSE '2024/05' END AS directory FROM r")
def plan_destination(spark, folder):
    return _routed(spark, folder).select("id", text.plan_directory(classify.folder(F.col("category")), F.lit("2024/05"), F.lit(True)).alias("directory"))


# ---------------------------------------------------------------- stills and videos

_LIVE = f"""
  WITH {FILES},
  k AS (SELECT path, CASE WHEN regexp_matches(lower(filename), '\\.(heic|heif|jpg|jpeg)$') THEN 'still' WHEN regexp_matches(lower(filename), '\\.mov$') THEN 'video' END AS kind, min((run_id || '-' || (id // 25))) AS identifier FROM files GROUP BY 1, 2),
  c AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, lower(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]+$', '')) AS stem FROM k WHERE kind IS NOT NULL),
  n AS (SELECT *, row_number() OVER (PARTITION BY kind, identifier, dir, stem ORDER BY string_split(path, '/')) AS n FROM c WHERE identifier IS NOT NULL),
  twin AS (SELECT a.path AS still, b.path AS video, a.identifier FROM n a JOIN n b USING (identifier, dir, stem, n) WHERE a.kind = 'still' AND b.kind = 'video'),
  free AS (SELECT kind, path, identifier, row_number() OVER (PARTITION BY kind, identifier ORDER BY string_split(path, '/')) AS n FROM n WHERE path NOT IN (SELECT still FROM twin) AND path NOT IN (SELECT video FROM twin)),
  verified AS (SELECT * FROM twin UNION ALL SELECT a.path, b.path, a.identifier FROM free a JOIN free b USING (identifier, n) WHERE a.kind = 'still' AND b.kind = 'video')
"""


def _candidates(spark, folder):
    files = latest_files(spark, folder, "path", "run_id").withColumn("tag", F.concat(F.col("run_id").cast("string"), F.lit("-"), F.floor(F.col("id") / 25).cast("string")))
    return live_photos.candidates(files, "path", "tag")


@query(_LIVE + "SELECT still, video, identifier FROM verified")
def pair_by_identifier(spark, folder):
    return live_photos.pairs(_candidates(spark, folder)).where("verified").select("still", "video", "identifier")


@query(_LIVE + "SELECT still, video, identifier, true AS verified FROM verified")
def pair_by_stem(spark, folder):
    return live_photos.scan_order(live_photos.pairs(_candidates(spark, folder)))


@query(_LIVE + "SELECT path, kind FROM c WHERE path NOT IN (SELECT still FROM verified) AND path NOT IN (SELECT video FROM verified)")
def pair_orphans(spark, folder):
    found = _candidates(spark, folder)
    return live_photos.orphans(found, live_photos.pairs(found))


# ---------------------------------------------------------------- reports, search, operation log


@query(f"WITH {FILES} SELECT id, run_id, group_id, path, coalesce(filename, regexp_replace(path, '^.*/', '')) AS filename, content_hash, CASE WHEN quality_score BETWEEN 0 AND 1 AND NOT isnan(quality_score) THEN quality_score END AS quality_score FROM files ORDER BY run_id, path, id")
def report_files_all(spark, folder):
    """The files of all runs; for one run there is ReportStore.list_media_files. Only numbers from 0 to 1 are scores."""
    score = F.when(F.col("quality_score").between(0, 1), F.col("quality_score")).alias("quality_score")
    rows = latest_files(spark, folder, "run_id", "group_id", "path", "filename", "content_hash", "quality_score")
    rows = rows.select("id", "run_id", "group_id", "path", F.coalesce("filename", text.basename(F.col("path"))).alias("filename"), "content_hash", score)
    return rows.orderBy(F.col("run_id").asc_nulls_last(), F.col("path").asc_nulls_last(), F.col("id").asc_nulls_last())


@query(f"WITH {FILES} SELECT run_id, group_id, count(*) AS file_count, min(path) AS first_path FROM files WHERE group_id IS NOT NULL AND deleted_at IS NULL GROUP BY 1, 2")
def report_groups(spark, folder):
    rows = latest_files(spark, folder, "run_id", "group_id", "path", "deleted_at").where("group_id IS NOT NULL AND deleted_at IS NULL")
    return rows.groupBy("run_id", "group_id").agg(F.count("*").alias("file_count"), F.min("path").alias("first_path"))


@query(f"""
  WITH {FILES}, one AS (SELECT path, min(id) AS media_file_id FROM files GROUP BY path),
  ops AS (SELECT seq, command_type, coalesce(json_extract_string(args_json, '$.source'), json_extract_string(args_json, '$.path')) AS source FROM commands QUALIFY row_number() OVER (PARTITION BY seq ORDER BY loaded_at DESC) = 1)
  SELECT seq, command_type, source, media_file_id FROM ops LEFT JOIN one ON one.path = ops.source
""")
def report_operations(spark, folder):
    """Operations with the file their source names, null if unknown."""
    ops = latest_rows(table(spark, folder, "commands", "seq", "command_type", "args_json", "loaded_at"), ["seq"], [F.col("loaded_at").desc()])
    ops = ops.select("seq", "command_type", F.coalesce(F.get_json_object("args_json", "$.source"), F.get_json_object("args_json", "$.path")).alias("source"))
    one = latest_files(spark, folder, "path").groupBy(F.col("path").alias("source")).agg(F.min("id").alias("media_file_id"))
    return ops.join(one, "source", "left").select("seq", "command_type", "source", "media_file_id")


@query(f"""
  WITH {FILES}, g AS (SELECT path FROM files WHERE group_id IS NOT NULL UNION ALL SELECT path FROM files WHERE run_id = 7 AND group_id IS NOT NULL UNION ALL SELECT '/nowhere')
  SELECT 'duplicate path' AS problem, path, count(*) AS n FROM files GROUP BY path HAVING count(*) > 1
  UNION ALL SELECT 'unknown group member', path, count(*) FROM g WHERE path NOT IN (SELECT path FROM files) GROUP BY path
  UNION ALL SELECT 'repeated group member', path, count(*) FROM g GROUP BY path HAVING count(*) > 1
""")
def export_violations(spark, folder):
    """The export checks on data with injected faults: members named twice, and one that is no file."""
    files = latest_files(spark, folder, "path", "run_id", "group_id")
    members = files.where("group_id IS NOT NULL").select("path").unionByName(files.where("run_id = 7 AND group_id IS NOT NULL").select("path")).unionByName(spark.createDataFrame([("/nowhere",)], "path string"))
    return report.violations(files, members)


@query("SELECT status AS value, count(*) AS n FROM commands WHERE status NOT IN ('in_progress', 'done', 'undone', 'failed', 'interrupted') GROUP BY 1")
def domain_check(spark, folder):
    return domain_violations(table(spark, folder, "commands", "status"), "commands").select("value", "n")


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM w WHERE list_contains(w, 'harbor') AND list_contains(w, 'rusty')")
def search_terms(spark, folder):
    return search.search(table(spark, folder, "documents", "doc_id", "text"), "doc_id", ["text"], "harbor RUSTY").select(F.col("doc").alias("doc_id"))


_TOKENS = "w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS t, regexp_extract_all(lower(strip_accents(coalesce(source, ''))), '[\\p{L}\\p{N}]+') AS s FROM documents)"
#: Relevance of "screenshot text" and tractor over text and source.
BM25 = "WITH " + _TOKENS + """,
  h AS (SELECT doc_id, len(t) + len(s) AS n, len([1 FOR i IN range(1, len(t)) IF t[i] = 'screenshot' AND t[i + 1] = 'text']) + len([1 FOR i IN range(1, len(s)) IF s[i] = 'screenshot' AND s[i + 1] = 'text']) AS a, len(list_filter(t, lambda x: x = 'tractor')) + len(list_filter(s, lambda x: x = 'tractor')) AS b FROM w),
  z AS (SELECT count(*) AS docs, avg(n) AS mean, count_if(a > 0) AS na, count_if(b > 0) AS nb FROM h),
  i AS (SELECT *, CASE WHEN ln((docs - na + 0.5) / (na + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - na + 0.5) / (na + 0.5)) END AS ia, CASE WHEN ln((docs - nb + 0.5) / (nb + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - nb + 0.5) / (nb + 0.5)) END AS ib FROM z),
  scored AS (SELECT doc_id, -(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM h, i WHERE a > 0 AND b > 0)
"""


@query(BM25 + "SELECT doc_id, score FROM scored")
def search_bm25(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return search.ranked(docs.drop("lang"), "doc_id", ["text", "source"], '"screenshot text" tractor').select("doc_id", "score")


@query("SELECT id, root_path, status, started_at, total_files FROM report_runs ORDER BY started_at, id")
def runs_listing(spark, folder):
    return table(spark, folder, "report_runs", "id", "root_path", "status", "started_at", "total_files").orderBy("started_at", "id")


_SESSIONS = "s AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY loaded_at DESC) = 1), c AS (SELECT * FROM commands QUALIFY row_number() OVER (PARTITION BY seq ORDER BY loaded_at DESC) = 1)"


def _sessions(spark, folder):
    newest = [F.col("loaded_at").desc()]
    sessions = latest_rows(table(spark, folder, "sessions", "session_id", "started_at", "completed_at", "status", "source", "loaded_at"), ["session_id"], newest)
    return sessions, latest_rows(table(spark, folder, "commands", "seq", "session_id", "command_type", "status", "loaded_at"), ["seq"], newest)


@query(f"WITH {_SESSIONS}, n AS (SELECT session_id, count(*) AS n FROM c GROUP BY 1) SELECT session_id, status, started_at, coalesce(n, 0) AS command_count FROM s LEFT JOIN n USING (session_id) ORDER BY started_at DESC, session_id DESC LIMIT 50")
def sessions_latest(spark, folder):
    """The newest sessions with their command counts (a page, as the log's reader gives it)."""
    sessions, commands = _sessions(spark, folder)
    return saga.newest_sessions(saga.with_command_counts(sessions, commands), 50).select("session_id", "status", "started_at", "command_count")


@query(f"WITH {_SESSIONS}, top AS (SELECT session_id FROM c GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1) SELECT seq, command_type, status FROM c WHERE session_id = (SELECT session_id FROM top) ORDER BY seq LIMIT 20 OFFSET 5")
def commands_page(spark, folder):
    _, commands = _sessions(spark, folder)
    top = commands.groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "session_id").first()
    return saga.command_page(commands, top["session_id"] if top else "", 20, 5).select("seq", "command_type", "status")


@query(f"WITH {_SESSIONS} SELECT session_id, completed_at FROM s WHERE status = 'completed' ORDER BY completed_at DESC NULLS LAST, session_id DESC LIMIT 1")
def latest_completed_session(spark, folder):
    return saga.latest_completed(_sessions(spark, folder)[0]).select("session_id", "completed_at")


@query(f"WITH {_SESSIONS} SELECT CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM s GROUP BY 1")
def interrupted_sessions(spark, folder):
    return saga.mark_interrupted(_sessions(spark, folder)[0]).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_SESSIONS}, gone AS (SELECT session_id FROM s WHERE status <> 'running' AND started_at < '2024-06-01') SELECT (SELECT count(*) FROM s WHERE session_id NOT IN (FROM gone)) AS n_sessions, (SELECT count(*) FROM c WHERE session_id NOT IN (FROM gone) OR session_id IS NULL) AS n_commands")
def sessions_deleted(spark, folder):
    """What a deletion of finished sessions before a cutoff leaves."""
    sessions, commands = _sessions(spark, folder)
    left, rest = saga.delete_sessions(sessions, commands, saga.deletable(sessions, "2024-06-01"))
    return left.agg(F.count("*").alias("n_sessions")).crossJoin(rest.agg(F.count("*").alias("n_commands")))


# ---------------------------------------------------------------- scalars


@query("SELECT file_id, CASE WHEN regexp_full_match(trim(captured_at, E' \\t\\r\\n' || chr(0)), '\\d{4}:\\d{1,2}:\\d{1,2} \\d{1,2}:\\d{1,2}:\\d{1,2}') THEN try_strptime(trim(captured_at, E' \\t\\r\\n' || chr(0)), '%Y:%m:%d %H:%M:%S') END AS captured FROM (SELECT DISTINCT file_id, captured_at FROM media_metadata)")
def exif_dates(spark, folder):
    rows = table(spark, folder, "media_metadata", "file_id", "captured_at").distinct()
    return rows.select("file_id", dates.exif_datetime(F.col("captured_at")).alias("captured"))


@query(f"WITH {FILES} SELECT id, CASE WHEN regexp_full_match(creation_date, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') THEN epoch_us(try_cast(creation_date AS TIMESTAMPTZ)) END AS micros FROM files")
def iso_dates(spark, folder):
    plain = F.when(F.col("creation_date").rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z"), F.col("creation_date"))
    return latest_files(spark, folder, "creation_date").select("id", F.unix_micros(dates.iso_datetime(plain)["at"]).alias("micros"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS report, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS stored, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS logged FROM events")
def utc_format(spark, folder):
    rows = table(spark, folder, "events", "event_id", "ts")
    return rows.select("event_id", dates.report_time(F.col("ts")).alias("report"), dates.default_time(F.col("ts")).alias("stored"), dates.log_time(F.col("ts")).alias("logged"))


@query("SELECT event_id, CASE WHEN value >= 0 AND NOT isnan(value) AND NOT isinf(value) THEN trunc(value)::BIGINT END AS whole, CASE WHEN value >= 0 AND NOT isnan(value) AND NOT isinf(value) THEN value END AS real FROM events")
def coerce_numbers(spark, folder):
    rows = table(spark, folder, "events", "event_id", "value")
    return rows.select("event_id", numbers.non_negative_int(F.col("value").cast("string"), via_float=True).alias("whole"), numbers.non_negative_float(F.col("value").cast("string")).alias("real"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN (l_suppkey % 3) > 0 AND l_partkey > 0 THEN l_partkey::DOUBLE / (l_suppkey % 3)::DOUBLE END AS rate FROM lineitem")
def frame_rates(spark, folder):
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", numbers.frame_rate(F.concat_ws("/", F.col("l_partkey").cast("string"), (F.col("l_suppkey") % 3).cast("string"))).alias("rate"))


@query("SELECT file_id, coalesce(codec, image_format, 'none') AS label FROM (SELECT DISTINCT file_id, codec, image_format FROM media_metadata)")
def first_available(spark, folder):
    rows = table(spark, folder, "media_metadata", "file_id", "codec", "image_format").distinct()
    return rows.select("file_id", numbers.first_available(F.coalesce("codec", F.lit("N/A")), F.col("image_format"), F.lit("none")).alias("label"))


@query("""
  SELECT file_id, '{' || array_to_string([x FOR x IN ['"width":' || width, '"height":' || height, '"codec":"' || codec || '"', '"has_alpha":' || has_alpha] IF x IS NOT NULL], ',') || '}' AS json
  FROM (SELECT DISTINCT file_id, width, height, codec, has_alpha FROM media_metadata)
""")
def metadata_json(spark, folder):
    rows = table(spark, folder, "media_metadata", "file_id", "width", "height", "codec", "has_alpha").distinct()
    return rows.select("file_id", report.metadata_json(F.struct("width", "height", "codec", "has_alpha")).alias("json"))


@query(f"WITH {FILES} SELECT id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN round_even(size_bytes / 1024, 1)::DECIMAL(18,1) || ' KiB' WHEN size_bytes < 1073741824 THEN round_even(size_bytes / 1048576, 1)::DECIMAL(18,1) || ' MiB' ELSE round_even(size_bytes / 1073741824, 1)::DECIMAL(18,1) || ' GiB' END AS label FROM files WHERE size_bytes >= 0")
def format_size(spark, folder):
    return latest_files(spark, folder, "size_bytes").where("size_bytes >= 0").select("id", text.format_size(F.col("size_bytes")).alias("label"))


@query("WITH v AS (SELECT vec_id, unnest([CASE WHEN x < -0.05 THEN 0 WHEN x < 0.05 THEN 1 ELSE 2 END FOR x IN embedding]) AS color FROM embeddings), n AS (SELECT vec_id, color, count(*) AS n FROM v GROUP BY ALL) SELECT vec_id, sum(n)::BIGINT AS total_pixels, count(*) AS distinct_colors, max(n) / sum(n) AS dominant_pixel_ratio FROM n GROUP BY 1")
def color_histogram(spark, folder):
    """The palette summary as an aggregation, over vectors cut into three colours."""
    color = lambda x: F.when(x < -0.05, 0).when(x < 0.05, 1).otherwise(2)
    cells = table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", F.explode(F.transform("embedding", color)).alias("color"))
    counts = cells.groupBy("vec_id", "color").agg(F.count("*").alias("n"))
    return counts.groupBy("vec_id").agg(F.sum("n").alias("total_pixels"), F.count("*").alias("distinct_colors"), (F.max("n") / F.sum("n")).alias("dominant_pixel_ratio"))


@query("SELECT customer.c_custkey, n_name, r_name, count(o_orderkey) AS n_orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def customer_orders(spark, folder):
    """A left outer join with a pre-aggregated side; the fixed nation and region tables are small enough to be broadcast by size."""
    orders = table(spark, folder, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, folder, "customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(orders, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def lineitem_totals(spark, folder):
    rows = table(spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"))


# ---------------------------------------------------------------- further views


@query(f"WITH {FILES}, {_REL} SELECT run_id, id, row_number() OVER (ORDER BY run_id, k, id) AS position FROM (SELECT files.id, run_id, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i < len(p) THEN '1' ELSE '0' END || p[i]) AS k FROM files JOIN (SELECT id, string_split(rel, '/') AS p FROM rel) USING (id))")
def walk_order_all(spark, folder):
    """The files of all runs, run by run, each in the order a walk visits them; numbered through."""
    rows = latest_files(spark, folder, "path", "run_id").withColumn("key", inventory.walk_key(F.ltrim("path", F.lit("/"))))
    order = [F.col("run_id").asc_nulls_last(), F.col("key").asc(), F.col("id").asc()]
    return hamming._running_number(rows, order).select("run_id", "id", F.col("group_number").alias("position"))


@query(f"WITH {FILES}, g AS (SELECT run_id, group_id, count(*) AS n, max(len(string_split(path, '/'))) AS depth FROM files WHERE group_id IS NOT NULL GROUP BY ALL) SELECT run_id, group_id, '{{\"group_number\":' || group_id || ',\"n_files\":' || n || ',\"max_depth\":' || depth || '}}' AS json FROM g")
def group_json(spark, folder):
    """Groups serialised, without their unbounded member lists."""
    rows = latest_files(spark, folder, "path", "run_id", "group_id").where("group_id IS NOT NULL")
    groups = rows.groupBy("run_id", "group_id").agg(F.count("*").alias("n_files"), F.max(F.size(text.path_key(F.col("path")))).alias("max_depth"))
    return groups.select("run_id", "group_id", F.to_json(F.struct(F.col("group_id").alias("group_number"), "n_files", "max_depth")).alias("json"))


@query(f"WITH {FILES}, a AS (SELECT run_id, total_files, duplicate_count FROM (SELECT id AS run_id, total_files, duplicate_count FROM report_runs)), b AS (SELECT run_id, count(*) AS n_files, count(group_id) AS n_grouped FROM files GROUP BY 1) SELECT run_id, total_files <> coalesce(n_files, 0) AS files_off, duplicate_count <> coalesce(n_grouped, 0) AS duplicates_off FROM a LEFT JOIN b USING (run_id)")
def run_consistency(spark, folder):
    """Runs whose stored counters disagree with their rows."""
    counts = latest_files(spark, folder, "run_id", "group_id").groupBy("run_id").agg(F.count("*").alias("n"), F.count("group_id").alias("g"))
    runs = table(spark, folder, "report_runs", "id", "total_files", "duplicate_count").withColumnRenamed("id", "run_id").join(counts, "run_id", "left")
    return runs.select("run_id", (F.col("total_files") != F.coalesce("n", F.lit(0))).alias("files_off"), (F.col("duplicate_count") != F.coalesce("g", F.lit(0))).alias("duplicates_off"))


@query("WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d) SELECT doc_id FROM s WHERE (contains(t, ' rusty ') OR contains(t, ' screenshot  text ')) AND NOT contains(t, ' trac')")
def search_expression(spark, folder):
    return search.matches(table(spark, folder, "documents", "doc_id", "text"), "doc_id", ["text"], '(rusty OR "screenshot text") NOT trac*').select(F.col("doc").alias("doc_id"))


@query("SELECT command_type, status, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM commands WHERE coalesce(trim(session_id), '') <> '' GROUP BY ALL")
def command_summary(spark, folder):
    rows = table(spark, folder, "commands", "command_type", "status", "seq", "session_id").where("coalesce(trim(session_id), '') <> ''")
    return rows.groupBy("command_type", "status").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# ---------------------------------------------------------------- streams


@query("SELECT seq, max(status) AS status FROM commands WHERE loaded_at IS NOT NULL GROUP BY seq")
def stream_commands_once(spark, folder):
    """Every command once, from a stream over the deliveries; a second delivery within the horizon is dropped."""
    from stratalens.streaming import latest
    from stratalens.work import Workspace

    ws = Workspace(spark, "stream")
    source = ws.save(table(spark, folder, "commands", "seq", "status", "loaded_at"), "deliveries")
    rows = spark.readStream.schema(source.schema).parquet(f"{ws.root}/001-deliveries")
    latest.drain(latest.deduplicated(rows, ["seq"], "loaded_at", "3650 days"), f"{ws.root}/out", f"{ws.root}/state").awaitTermination()
    return spark.read.parquet(f"{ws.root}/out").select("seq", "status")
