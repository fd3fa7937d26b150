"""Queries of the operators on records: listings, pairing, batches, report tables, logs, search and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import dates, hashing, text
from stratalens.operators import cache, hamming, inventory, live_photos, report, saga, search
from stratalens.operators.latest import latest_rows
from stratalens.plans.library import _GROUPS, _SESSIONS, _TOKENS, _WORDS, BM25, FILES, NEAR, _hashes, latest_files, query
from stratalens.schemas import domain_violations
from stratalens.tables import table
from stratalens.work import Workspace, stored_path

# ---------------------------------------------------------------- listings


def _listing(spark, folder) -> DataFrame:
    """The live files as a listing in which some entries are links to the file of the run's smallest id, some directories, some of no media type."""
    rows = latest_files(spark, folder, "path", "run_id", "media_type", "size_bytes").withColumn("rel", F.concat(F.col("run_id").cast("string"), F.col("path")))
    kind = F.when(F.col("id") % 13 > 0, F.col("media_type"))
    return rows.select("id", "rel", (F.col("id") % 19 == 0).alias("is_dir"), (F.col("id") % 7 == 0).alias("is_symlink"), F.col("size_bytes").alias("size"), kind.alias("media_type"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("target-"), (F.col("id") % 50).cast("string"))).alias("resolved"))


_LISTED = f"WITH {FILES}, l AS (SELECT id, run_id || path AS rel, id % 19 = 0 AS is_dir, id % 7 = 0 AS is_link, CASE WHEN id % 13 > 0 THEN media_type END AS kind, CASE WHEN id % 7 = 0 THEN 'target-' || id % 50 ELSE run_id || path END AS target FROM files)"


@query(_LISTED + " SELECT rel FROM l WHERE NOT is_dir AND NOT is_link AND kind IS NOT NULL AND len(string_split(rel, '/')) - 1 <= 5 AND NOT regexp_matches(rel, '(^|/)IMG_[^/]*$')")
def discover_skip(spark, folder):
    """Discovery that skips links: regular media files within the depth and outside the excluded patterns."""
    return inventory.discover(_listing(spark, folder), ["IMG_*"], 5)[0].select("rel")


@query(_LISTED + " SELECT CASE WHEN is_link THEN 'link' ELSE 'file' END AS kind, count(*) AS n FROM l WHERE NOT is_dir AND is_link GROUP BY 1")
def discover_issues(spark, folder):
    """The links that discovery reports."""
    issues = inventory.discover(_listing(spark, folder))[1]
    return issues.groupBy(F.when(F.col("message") == "symbolic link skipped", "link").otherwise("file").alias("kind")).agg(F.count("*").alias("n"))


@query(_LISTED + """, k AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i < len(p) THEN '1' ELSE '0' END || p[i]) AS key FROM (SELECT *, string_split(rel, '/') AS p FROM l WHERE NOT is_dir)),
  f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY key) AS rn FROM k) SELECT rel FROM f WHERE rn = 1 AND kind IS NOT NULL""")
def discover_follow(spark, folder):
    """Discovery that follows links: of several entries for one file the first of the walk."""
    return inventory.discover(_listing(spark, folder), symlinks="follow")[0].select("rel")


@query(_LISTED + ", k AS (SELECT rel, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i < len(p) THEN '1' ELSE '0' END || p[i]) AS key FROM (SELECT *, string_split(rel, '/') AS p FROM l WHERE NOT is_dir AND NOT is_link AND kind IS NOT NULL)), n AS (SELECT rel, row_number() OVER (ORDER BY key, rel) AS accepted, count(*) OVER () AS total FROM k) SELECT accepted, rel FROM n WHERE accepted % 100 = 0 OR accepted = total")
def discovery_progress(spark, folder):
    """Progress of discovery: every hundredth accepted file, and the last one."""
    return inventory.progress(inventory.discover(_listing(spark, folder))[0]).select("accepted", "rel")


@query(f"WITH {FILES}, r AS (SELECT id, CASE WHEN id % 2 = 0 THEN regexp_replace(ltrim(path, '/'), '^[^/]+/', '') ELSE ltrim(path, '/') END AS rel FROM files) SELECT id, len(string_split(rel, '/')) - 1 AS depth FROM r WHERE len(string_split(rel, '/')) - 1 <= 3")
def filter_depth_three(spark, folder):
    """A depth that half of the files exceed: the others are listed from one directory further down."""
    rel = F.ltrim("path", F.lit("/"))
    rel = F.when(F.col("id") % 2 == 0, F.regexp_replace(rel, r"\A[^/]+/", "")).otherwise(rel)
    return latest_files(spark, folder, "path").where(inventory.depth(rel) <= 3).select("id", inventory.depth(rel).cast("bigint").alias("depth"))


@query(f"WITH {FILES}, s AS (SELECT count(*) AS n, sum(size_bytes)::BIGINT AS b FROM files) SELECT 'files' AS metric, n::VARCHAR AS value FROM s UNION ALL SELECT 'total_bytes', b::VARCHAR FROM s UNION ALL SELECT media_type, count(*)::VARCHAR FROM files GROUP BY 1")
def stats_rows(spark, folder):
    """The statistics as rows of metric and value, as the command line prints them."""
    stats = inventory.directory_stats(latest_files(spark, folder, "media_type", "size_bytes"), "media_type", "size_bytes", F.col("loaded_at"))
    return inventory.stats_rows(stats)


# ---------------------------------------------------------------- pairing


_LOOSE = f"""
  WITH {FILES},
  k AS (SELECT DISTINCT '/r' || run_id || '/d' || id % 97 || '/IMG_' || (id // 97) % 5 || '.' || lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS path, run_id, id % 97 AS d, (id // 97) % 5 AS s FROM files),
  c AS (SELECT path, CASE WHEN regexp_matches(path, '\\.(heic|heif|jpg|jpeg)$') THEN 'still' WHEN regexp_matches(path, '\\.mov$') THEN 'video' END AS kind, run_id, d, s FROM k),
  i AS (SELECT *, CASE WHEN (d + s) % 3 = 1 OR kind = CASE WHEN (d + s) % 3 = 0 THEN 'still' ELSE 'video' END THEN kind || run_id || '-' || d || '-' || s END AS identifier FROM c WHERE kind IS NOT NULL)
"""


def _loose(spark, folder) -> DataFrame:
    """Stills and videos of which one in three pairs has identifiers on neither, one or both sides, never the same one."""
    d, s = F.col("id") % 97, F.floor(F.col("id") / 97) % 5
    name = F.concat(F.lit("/r"), F.col("run_id"), F.lit("/d"), d, F.lit("/IMG_"), s, F.lit("."), F.lower(text.normalize_extension(F.col("filename"))))
    rows = latest_files(spark, folder, "filename", "run_id").select(name.alias("path"), "run_id", d.alias("d"), s.alias("s")).distinct()
    ext = text.normalize_extension(F.col("path"))
    kind = F.when(ext.isin(*inventory.STILLS), "still").when(ext.isin(*inventory.VIDEOS), "video")
    turn = (F.col("d") + F.col("s")) % 3
    tag = F.when((turn == 1) | (kind == F.when(turn == 0, "still").otherwise("video")), F.concat(kind, F.col("run_id"), F.lit("-"), F.col("d"), F.lit("-"), F.col("s")))
    return live_photos.candidates(rows.select("path", tag.alias("tag")), "path", "tag")


@query(_LOOSE + """, p AS (SELECT s.path AS still, v.path AS video, row_number() OVER (PARTITION BY v.path ORDER BY string_split(s.path, '/')) AS n FROM i s JOIN i v ON s.run_id = v.run_id AND s.d = v.d AND s.s = v.s WHERE s.kind = 'still' AND v.kind = 'video' AND (s.identifier IS NULL OR v.identifier IS NULL))
  SELECT still, video FROM p WHERE n = 1""")
def pair_greedy(spark, folder):
    """Stills and videos that only share directory and stem: paired where one side has no identifier, the first still in path order."""
    return live_photos.pairs(_loose(spark, folder)).where("NOT verified").select("still", "video")


# ---------------------------------------------------------------- hashing in batches, distances, group members


@query("""
  WITH d AS (SELECT doc_id, source, text, CASE source WHEN 'phone_import' THEN NULL WHEN 'screenshot_text' THEN 'content-md5' ELSE 'content-sha256' END AS algorithm FROM documents),
  o AS (SELECT doc_id, algorithm, CASE WHEN algorithm = 'content-md5' OR algorithm IS NULL THEN NULL WHEN doc_id % 4 = 0 THEN 'sha256:' || repeat('0', 64) WHEN text IS NOT NULL THEN 'sha256:' || sha256(text) END AS sha,
    CASE WHEN algorithm = 'content-md5' AND text IS NOT NULL THEN 'sha256:' || sha256(text) END AS md FROM d)
  SELECT doc_id, algorithm, coalesce(sha, md) AS hash, CASE WHEN algorithm IS NULL THEN 'skipped' WHEN algorithm = 'content-sha256' AND doc_id % 4 = 0 THEN 'cached' WHEN coalesce(sha, md) IS NULL THEN 'failed' ELSE 'hashed' END AS status FROM o
""")
def batch_hashing(spark, folder):
    """Cache-first hashing of texts: cached, hashed, failed, or skipped where no hasher is set."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    files = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("path"), F.col("source").alias("media_type"), F.lit(1.0).alias("mtime"), F.lit(1).cast("bigint").alias("size"), F.col("text").alias("content"))
    kinds = {r.source: "content-md5" if r.source == "screenshot_text" else "content-sha256" for r in docs.select("source").distinct().collect() if r.source not in (None, "phone_import")}  # the kinds of sources
    stored = files.where((F.col("ord") % 4 == 0) | (F.col("ord") % 4 == 1)).select("path", F.lit("content-sha256").alias("algorithm"), "mtime", "size", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("sha256:"), F.repeat(F.lit("0"), 64))).otherwise("broken").alias("hash"))
    outcomes, _ = cache.batch(files, kinds, stored, hashing.content_digest, hashing.valid_content_digest(F.col("hash")))
    return outcomes.select(F.col("ord").alias("doc_id"), "algorithm", "hash", "status")


@query("WITH " + _WORDS + """, n AS (SELECT *, lead(ord) OVER w AS next, lead(hex) OVER w AS hex2, lead(ws) OVER w AS ws2, lead(alg) OVER w AS alg2 FROM (SELECT h.*, d.algorithm AS alg FROM h JOIN digests d USING (ord)) WINDOW w AS (ORDER BY ord))
  SELECT ord, next, CASE WHEN alg = alg2 OR alg IS NULL OR alg2 IS NULL THEN CASE WHEN length(hex) = length(hex2) THEN list_sum([bit_count(xor(ws[i], ws2[i])) FOR i IN range(1, len(ws) + 1)])::INT END END AS distance,
    CASE WHEN alg <> alg2 THEN 'algorithms differ' WHEN length(hex) <> length(hex2) THEN 'widths differ' END AS error FROM n WHERE next IS NOT NULL""")
def digest_distances(spark, folder):
    """Distance of every hash to the next valid one by ord, or why there is none."""
    files = table(spark, folder, "hashed_files", "ord", "path", "perceptual_hash", "media_type").distinct()
    valid = files.select("ord", F.explode(F.array(hashing.digest_parts(F.col("perceptual_hash")))).alias("d")).where("d.error IS NULL")
    numbered = hamming._running_number(valid, [F.col("ord").asc()]).select(F.col("group_number").alias("n"), "ord", "d")
    other = numbered.select((F.col("n") - 1).alias("n"), F.col("ord").alias("next"), F.col("d").alias("e"))
    both = numbered.join(other, "n").select("ord", "next", F.explode(F.array(hashing.digest_distance(F.col("d"), F.col("e")))).alias("d"))
    return both.select("ord", "next", "d.distance", "d.error")


@query("WITH RECURSIVE " + _GROUPS + """, m AS (SELECT n.group_number, m.path, (row_number() OVER (PARTITION BY n.group_number ORDER BY string_split(m.path, '/')) - 1) // 100 AS part FROM members m JOIN numbered n USING (label))
  SELECT group_number, part, count(*) AS n_files, array_to_string(list(path ORDER BY string_split(path, '/')), '|') AS files FROM m GROUP BY 1, 2""")
def group_files(spark, folder):
    """The files of every duplicate group in path order, in parts of a hundred."""
    files = table(spark, folder, "hashed_files", "ord", "path", "perceptual_hash", "media_type").distinct()
    groups = hamming.duplicate_groups(files, "path", "perceptual_hash", "media_type", "ord", NEAR, strict=False)
    return hamming.serialised(groups, "group_number", "path", text.path_key(F.col("path")), 100).select("group_number", "part", "n_files", F.array_join("files", "|").alias("files"))


@query("WITH RECURSIVE " + _GROUPS + """, e AS (SELECT ord_a, ord_b, distance FROM near WHERE distance <= 5 UNION ALL SELECT ord_a, ord_b, 0 FROM chain WHERE ord_a IS NOT NULL)
  SELECT n.group_number, count(*) AS n_pairs, max(distance)::INT AS widest, min(greatest(0.0::DOUBLE, 1.0::DOUBLE - distance / h.bits)) AS least_similarity FROM e JOIN label l ON l.ord = e.ord_a JOIN numbered n USING (label) JOIN h ON h.ord = e.ord_a GROUP BY 1""")
def group_pairs(spark, folder):
    """How many pairs hold every duplicate group together, and how far apart they are at most."""
    rows = Workspace(spark, "pairs").save(_hashes(spark, folder), "rows")
    files = table(spark, folder, "hashed_files", "ord", "path", "perceptual_hash", "media_type").distinct()
    groups = hamming.duplicate_groups(files, "path", "perceptual_hash", "media_type", "ord", NEAR, strict=False).select(F.col("ord").alias("ord_a"), "group_number")
    edges = hamming.edges(rows, NEAR).join(groups, "ord_a")
    return edges.groupBy("group_number").agg(F.count("*").alias("n_pairs"), F.max("distance").alias("widest"), F.min("similarity").alias("least_similarity"))


# ---------------------------------------------------------------- report tables

_EXPORT = f"""
  WITH {FILES}, u AS (SELECT path, min(id) AS id FROM files GROUP BY path), f AS (SELECT files.* FROM files JOIN u USING (id)),
  g AS (SELECT run_id, group_id, dense_rank() OVER (ORDER BY run_id, group_id) AS number, path, media_type FROM f WHERE group_id IS NOT NULL),
  s AS (SELECT number, min(path) AS target_path, count(*) AS n FROM g GROUP BY number)
"""


def _export(spark, folder) -> report.RunExport:
    """All paths of the library as one run; groups numbered by (run, group), each with its smallest path as target."""
    files = latest_files(spark, folder, "path", "run_id", "group_id", "media_type", "size_bytes", "content_hash", "quality_score")
    files = files.join(files.groupBy("path").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    files = Workspace(spark, "export").save(files, "files")
    members = files.where("group_id IS NOT NULL")
    numbers = hamming._running_number(members.select("run_id", "group_id").distinct(), [F.col("run_id").asc(), F.col("group_id").asc()])
    members = members.join(numbers, ["run_id", "group_id"]).select("group_number", F.lit("image").alias("media_type"), "path")
    targets = members.groupBy("group_number").agg(F.min("path").alias("target_path"))
    operations = spark.createDataFrame([("move", "applied", "/nowhere", "/else")], "operation string, status string, source string, destination string")
    return report.RunExport("/library", files.select("path", "media_type", "size_bytes", "content_hash", "quality_score"), members.join(targets, "group_number"), operations)


@query(_EXPORT + "SELECT number AS group_number, n AS file_count, target_path, target_path AS best_path, n AS n_members FROM s")
def report_roundtrip(spark, folder):
    """A run written to a store and read back: groups with their members and the file their target names."""
    store = report.ReportStore(spark, f"{Workspace(spark, 'store').root}/store")
    run = store.export(_export(spark, folder))
    files, groups = store.table("media_files", run), store.list_groups(run)
    members = files.where("group_id IS NOT NULL").groupBy(F.col("group_id").alias("group_number")).agg(F.count("*").alias("n_members"))
    best = groups.join(files.select(F.col("id").alias("best_file_id"), F.col("path").alias("best_path")), "best_file_id", "left")
    return best.join(members, "group_number", "left").select("group_number", "file_count", "target_path", "best_path", "n_members")


@query(_EXPORT + """SELECT status, total_files, duplicate_count, n_files, n_groups, n_detached, changed FROM (SELECT 'completed' AS status, 7::BIGINT AS total_files, (SELECT count(*) FROM g) AS duplicate_count, (SELECT count(*) FROM f) AS n_files, (SELECT count(*) - 1 FROM s) AS n_groups,
  (SELECT count(*) FROM f WHERE group_id IS NULL) + (SELECT n FROM s WHERE number = 1) AS n_detached, 1 AS changed)""")
def report_updates(spark, folder):
    """The store after an update of the run, the deletion of its first group and a new best file: what changed, and what stayed."""
    store = report.ReportStore(spark, f"{Workspace(spark, 'store').root}/store")
    run = store.export(_export(spark, folder))
    store.update_run(run, "completed", total_files=7)
    changed = store.delete_group(run, 1) + store.delete_group(run, 1)
    row = store.table("report_runs", run).select("status", "total_files", "duplicate_count")
    files = store.table("media_files", run).agg(F.count("*").alias("n_files"), F.count_if(F.col("group_id").isNull()).alias("n_detached"))
    groups = store.table("duplicate_groups", run).agg(F.count("*").alias("n_groups"))
    return row.crossJoin(files).crossJoin(groups).withColumn("changed", F.lit(changed))  # one row each


@query("WITH s AS (SELECT CASE WHEN seq % 10 = 0 THEN upper(status) ELSE status END AS status FROM commands), r AS (SELECT CASE WHEN id % 3 = 0 THEN 'odd' ELSE status END AS status FROM report_runs) SELECT 'commands' AS source, status AS value, count(*) AS n FROM s WHERE status NOT IN ('in_progress', 'done', 'undone', 'failed', 'interrupted') GROUP BY ALL UNION ALL SELECT 'report_runs', status, count(*) FROM r WHERE status NOT IN ('running', 'completed', 'failed') GROUP BY ALL")
def domain_faults(spark, folder):
    """Values outside their domain, in tables with injected faults."""
    commands = table(spark, folder, "commands", "seq", "status").withColumn("status", F.when(F.col("seq") % 10 == 0, F.upper("status")).otherwise(F.col("status")))
    runs = table(spark, folder, "report_runs", "id", "status").withColumn("status", F.when(F.col("id") % 3 == 0, "odd").otherwise(F.col("status")))
    parts = [domain_violations(df, name).select(F.lit(name).alias("source"), "value", "n") for name, df in (("commands", commands), ("report_runs", runs))]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- the operation log


@query(f"WITH {_SESSIONS}, l AS (SELECT DISTINCT seq, session_id, command_type, status, args_json, log_json, started_at, completed_at FROM c) SELECT seq, session_id, command_type, status, args_json, CASE WHEN status <> 'in_progress' THEN log_json END AS log_json, started_at, CASE WHEN status <> 'in_progress' THEN completed_at END AS completed_at FROM l")
def saga_replay(spark, folder):
    """The commands' states from a log of two events each: begun, and, unless still in progress, ended."""
    _, newest = None, [F.col("loaded_at").desc()]
    rows = latest_rows(table(spark, folder, "commands", "seq", "session_id", "command_type", "args_json", "log_json", "status", "started_at", "completed_at", "loaded_at"), ["seq"], newest)
    null = F.lit(None).cast("string")
    blank = [null.alias(c) for c in ("source", "destination", "config_digest")]
    begun = rows.select((F.col("seq") * 2).alias("n"), F.lit("command").alias("kind"), "session_id", "seq", "command_type", "args_json", null.alias("log_json"), F.lit("in_progress").alias("status"), *blank, F.col("started_at").alias("at"))
    ended = rows.where("status <> 'in_progress'").select((F.col("seq") * 2 + 1).alias("n"), F.lit("command").alias("kind"), null.alias("session_id"), "seq", null.alias("command_type"), null.alias("args_json"), "log_json", "status", *blank, F.col("completed_at").alias("at"))
    return saga.command_view(begun.unionByName(ended)).select("seq", "session_id", "command_type", "status", "args_json", "log_json", "started_at", "completed_at")


@query(f"WITH {_SESSIONS} SELECT session_id, seq FROM c WHERE status = 'done' AND session_id IN (SELECT session_id FROM s WHERE status = 'failed')")
def undo_order(spark, folder):
    """The commands to reverse of the failed sessions, last first."""
    newest = [F.col("loaded_at").desc()]
    sessions = latest_rows(table(spark, folder, "sessions", "session_id", "status", "loaded_at"), ["session_id"], newest).where("status = 'failed'").select("session_id")
    commands = latest_rows(table(spark, folder, "commands", "seq", "session_id", "status", "loaded_at"), ["seq"], newest)
    return saga.pending_undo(commands.join(sessions, "session_id", "left_semi")).select("session_id", "seq")


# ---------------------------------------------------------------- search


def _index(spark, folder, *columns: str) -> search.SearchIndex:
    """The stored postings of the documents' columns, built when the work folder has none of the same files yet."""
    rows = table(spark, folder, "documents", "doc_id", *columns)

    def build(path: str) -> DataFrame:
        search.SearchIndex(spark, path).build(rows, "doc_id", list(columns))
        return rows

    return search.SearchIndex(spark, stored_path(rows, "search-index", build))


@query(BM25 + "SELECT doc_id, round(score, 8) AS score FROM scored")
def search_relevance(spark, folder):
    """Relevance from stored postings: a phrase and a word over two columns."""
    return _index(spark, folder, "text", "source").search('"screenshot text" tractor').select(F.col("doc").alias("doc_id"), F.round("score", 8).alias("score"))


@query("WITH " + _TOKENS + " SELECT doc_id FROM w WHERE (list_contains(t, 'foret') OR list_contains(s, 'foret')) AND (list_contains(t, 'pres') OR list_contains(s, 'pres'))")
def search_folded(spark, folder):
    """Accents and case don't count, in the query as in the texts."""
    return _index(spark, folder, "text", "source").search("FORÊT près").select(F.col("doc").alias("doc_id"))


# ---------------------------------------------------------------- names


@query(f"WITH {FILES} SELECT id, filename || '_x_' || id AS safe, 'scan: ' || path || ': late' AS issue, strftime(loaded_at, '%Y%m%dT%H%M%S') || '-' || lower(substr(md5(path), 1, 8)) AS session, CASE WHEN deleted_at >= loaded_at THEN (epoch_us(deleted_at) - epoch_us(loaded_at)) / 1e6 END AS seconds, CASE WHEN contains(filename, '.') THEN upper(regexp_extract(filename, '\\.([^.]+)$', 1)) END AS format FROM files")
def names_and_labels(spark, folder):
    """Safe file names, issue texts, session ids, elapsed seconds and formats by suffix."""
    files = latest_files(spark, folder, "filename", "path", "deleted_at")
    dirty = F.concat(F.lit("  "), F.col("filename"), F.lit("/x\u0007"), F.col("id").cast("string"), F.lit(". "))
    return files.select(
        "id", text.sanitized(dirty).alias("safe"), text.issue_text(F.lit("scan"), F.col("path"), F.lit("late")).alias("issue"), dates.session_id(F.col("loaded_at"), F.md5("path")).alias("session"),
        dates.elapsed_seconds(F.col("loaded_at"), F.col("deleted_at")).alias("seconds"), text.format_of(F.col("path")).alias("format"),
    )


@query("SELECT media_type, count(*) AS n_valid, sum(length(trim(split_part(t, ':', 3)))) AS digits FROM (SELECT DISTINCT ord, media_type, trim(perceptual_hash, E' \\t\\r\\n') AS t FROM hashed_files) WHERE regexp_full_match(t, '[^:]+:[0-9]+:[0-9a-fA-F]+') AND split_part(t, ':', 2)::BIGINT ** 2 = length(split_part(t, ':', 3)) * 4 GROUP BY 1")
def serialised_digests(spark, folder):
    """Hashes that name their algorithm, taken apart and written again: how many come back as the same digest."""
    files = table(spark, folder, "hashed_files", "ord", "perceptual_hash", "media_type").distinct()
    parts = files.select("media_type", F.explode(F.array(hashing.digest_parts(F.col("perceptual_hash")))).alias("d")).where("d.algorithm IS NOT NULL")
    again = parts.select("media_type", "d", F.explode(F.array(hashing.serialize_perceptual(F.col("d.algorithm"), F.sqrt("d.bits").cast("int"), F.col("d.hex")))).alias("t"))
    again = again.select("media_type", "d", F.explode(F.array(hashing.digest_parts(F.col("t")))).alias("e"))
    return again.where("d.hex = e.hex AND d.algorithm = e.algorithm AND d.bits = e.bits").groupBy("media_type").agg(F.count("*").alias("n_valid"), F.sum(F.length("e.hex")).alias("digits"))
