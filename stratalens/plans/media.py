"""Queries of the readers of bytes, pixels and probe output. The files are made in the query from the tables' columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import dates, images, media_bytes, text
from stratalens.plans.library import FILES, latest_files, query
from stratalens.sources import files as sources
from stratalens.sources import probes
from stratalens.tables import table

# ---------------------------------------------------------------- files as hexadecimal text


def _hex(value: Column | int, digits: int) -> Column:
    """A number as so many digits, the highest byte first."""
    return F.lpad(F.hex(F.lit(value) if isinstance(value, int) else value.cast("bigint")), digits, "0")


def _little(value: Column | int, digits: int) -> Column:
    h = _hex(value, digits)
    return F.concat(*[F.substring(h, at, 2) for at in range(digits - 1, 0, -2)])


def _text(value: Column | str) -> Column:
    return F.hex(F.encode(F.lit(value) if isinstance(value, str) else value, "UTF-8"))


def _size(h: Column) -> Column:
    return F.length(h) / 2


def png_chunk(kind: str, body: Column) -> Column:
    return F.concat(_hex(_size(body), 8), _text(kind), body, F.lit("00000000"))


def png(width: Column, height: Column, color: Column, *chunks: Column) -> Column:
    """color is 0 gray, 2 RGB, 4 gray and alpha, 6 RGB and alpha; eight bits a channel."""
    head = F.concat(_hex(width, 8), _hex(height, 8), F.lit("08"), _hex(color, 2), F.lit("000000"))
    return F.concat(F.lit("89504E470D0A1A0A"), png_chunk("IHDR", head), *chunks, png_chunk("IEND", F.lit("")))


def jpeg_segment(marker: str, body: Column) -> Column:
    return F.concat(F.lit("FF" + marker), _hex(_size(body) + 2, 4), body)


def jpeg(width: Column, height: Column, channels: Column, *segments: Column) -> Column:
    frame = F.concat(F.lit("08"), _hex(height, 4), _hex(width, 4), _hex(channels, 2), F.lit("00" * 9))
    return F.concat(F.lit("FFD8"), *segments, jpeg_segment("C0", frame), F.lit("FFDA"))


def directory(start: int, entries: list[tuple[int, int, Column | int, Column]]) -> Column:
    """A little-endian tag directory at byte `start`: entries (tag, kind, count, value); values over four bytes follow it."""
    rows, tail, offset = [], [], F.lit(start + 2 + 12 * len(entries) + 4).cast("bigint")
    for tag, kind, count, value in entries:
        long = _size(value) > 4
        rows.append(F.concat(_little(tag, 4), _little(kind, 4), _little(count, 8), F.when(long, _little(offset, 8)).otherwise(F.rpad(value, 8, "0"))))
        tail.append(F.when(long, value).otherwise(""))
        offset = offset + F.when(long, _size(value)).otherwise(0).cast("bigint")
    return F.concat(_little(len(entries), 4), *rows, F.lit("00000000"), *tail)


def ascii_tag(tag: int, value: Column) -> tuple[int, int, Column, Column]:
    body = F.concat(_text(value), F.lit("00"))
    return tag, 2, _size(body), body


def tiff(entries: list, sub: list) -> Column:
    """A little-endian TIFF block with an EXIF subdirectory, whose fixed place comes before the main one."""
    below = directory(8, sub)
    start = 8 + _size(below)
    main = directory(0, [*entries, (0x8769, 4, 1, _little(8, 8))])
    # values of the main directory are counted from its own start, so it may hold only short ones
    return F.concat(F.lit("49492A00"), _little(start, 8), below, main)


def _metadata(spark, folder, *columns: str) -> DataFrame:
    return table(spark, folder, "media_metadata", "file_id", *columns).distinct()


# ---------------------------------------------------------------- headers and tags

_SHAPES = """
  m AS (SELECT DISTINCT file_id, width, height, image_format, color_mode, has_alpha FROM media_metadata WHERE width IS NOT NULL AND height IS NOT NULL AND image_format IS NOT NULL),
  x AS (SELECT *, color_mode = 'L' AS g, coalesce(has_alpha, false) AS a FROM m)
"""


@query("WITH " + _SHAPES + """
  SELECT file_id, width, height, image_format, CASE WHEN image_format = 'JPEG' THEN CASE WHEN g THEN 'L' ELSE 'RGB' END WHEN image_format = 'HEIF' THEN 'RGB' WHEN image_format = 'WEBP' THEN CASE WHEN a THEN 'RGBA' ELSE 'RGB' END
    WHEN g AND a THEN 'LA' WHEN g THEN 'L' WHEN a THEN 'RGBA' ELSE 'RGB' END AS color_mode, 8::BIGINT AS bit_depth, a AND image_format NOT IN ('JPEG', 'HEIF') AS has_alpha
  FROM (SELECT file_id, width, height, image_format, coalesce(g, false) AS g, a FROM x)
""")
def image_headers(spark, folder):
    """Width, height, format, mode, depth and alpha read from the bytes of PNG, JPEG, TIFF, WebP and HEIF files."""
    m = _metadata(spark, folder, "width", "height", "image_format", "color_mode", "has_alpha").where("width IS NOT NULL AND height IS NOT NULL AND image_format IS NOT NULL")
    gray, alpha, w, h = F.coalesce(F.col("color_mode") == "L", F.lit(False)), F.coalesce("has_alpha", F.lit(False)), F.col("width"), F.col("height")
    samples = F.when(gray, 1).otherwise(3) + F.when(alpha, 1).otherwise(0)
    made = {
        "PNG": png(w, h, F.when(gray & alpha, 4).when(gray, 0).when(alpha, 6).otherwise(2)),
        "JPEG": jpeg(w, h, F.when(gray, 1).otherwise(3)),
        "TIFF": F.concat(F.lit("49492A0008000000"), directory(8, [(0x100, 4, 1, _little(w, 8)), (0x101, 4, 1, _little(h, 8)), (0x102, 3, 1, _little(8, 4)), (0x106, 3, 1, F.when(gray, "0100").otherwise("0200")), (0x115, 3, 1, _little(samples, 4))])),
        "WEBP": F.concat(F.lit("52494646"), _little(30, 8), _text("WEBPVP8X"), _little(10, 8), F.when(alpha, "10000000").otherwise("00000000"), _little(w - 1, 6), _little(h - 1, 6)),
        "HEIF": F.concat(_hex(16, 8), _text("ftypheic"), F.lit("00000000"), _hex(20, 8), _text("ispe"), F.lit("00000000"), _hex(w, 8), _hex(h, 8)),
    }
    content = reduce(lambda acc, kv: F.when(F.col("image_format") == kv[0], kv[1]).otherwise(acc), made.items(), F.lit(None).cast("string"))
    return m.select("file_id", media_bytes.image_header(F.unhex(content)).alias("h")).select("file_id", "h.*")


def _exif(files: DataFrame) -> DataFrame:
    """files (id, filename) with a JPEG that holds EXIF tags made from them."""
    sub = [
        ascii_tag(0x9003, F.concat(F.lit("20"), F.lpad((F.col("id") % 30).cast("string"), 2, "0"), F.lit(":05:06 07:08:09"))), (0x829A, 5, 1, F.concat(_little(1, 8), _little(F.col("id") % 99 + 1, 8))),
        ascii_tag(0xA434, F.col("filename")), (0xA432, 3, 3, F.concat(_little(1, 4), _little(2, 4), _little(F.col("id") % 7, 4))), (0x927C, 7, 4, F.lit("41414141")),
    ]
    main = [ascii_tag(0x010F, F.lit("Kal")), (0x0112, 3, 1, _little(F.col("id") % 8 + 1, 4)), ascii_tag(0x0131, F.lit("")), (0xC999, 4, 1, _little(F.col("id"), 8))]
    block = F.concat(_text("Exif"), F.lit("0000"), tiff(main, sub))
    return files.withColumn("content", F.unhex(jpeg(F.lit(4), F.lit(3), F.lit(3), jpeg_segment("E1", block))))


@query(f"WITH {FILES} SELECT id, 'Kal' AS make, (id % 8 + 1)::VARCHAR AS orientation, id::VARCHAR AS unknown, '20' || lpad((id % 30)::VARCHAR, 2, '0') || ':05:06 07:08:09' AS taken, round(1.0 / (id % 99 + 1), 9) AS exposure, filename AS lens, '(1, 2, ' || (id % 7) || ')' AS spec, 7 AS n_tags FROM files")
def exif_fields(spark, folder):
    """All tags of both directories by name or number, without maker notes and empty texts."""
    tags = _exif(latest_files(spark, folder, "filename")).select("id", media_bytes.exif_tags(F.col("content")).alias("t"))
    return tags.select(
        "id", F.col("t.Make").alias("make"), F.col("t.Orientation").alias("orientation"), F.col("t")["51609"].alias("unknown"), F.col("t.DateTimeOriginal").alias("taken"),
        F.round(F.col("t.ExposureTime").cast("double"), 9).alias("exposure"), F.col("t.LensModel").alias("lens"), F.col("t.LensSpecification").alias("spec"), F.size(F.map_filter("t", lambda k, _: k != "ExifOffset")).alias("n_tags"),
    )


@query(f"WITH {FILES} SELECT id, filename AS prompt, path AS comment, '<x>' || run_id || '</x>' AS xmp, CASE WHEN id % 3 = 0 THEN hex(filename) END AS c2pa FROM files")
def png_chunks(spark, folder):
    """Text chunks, XMP packet and C2PA manifest of PNG files."""
    key = lambda name, kind, body: png_chunk(kind, F.concat(_text(name), F.lit("00"), body))
    files = latest_files(spark, folder, "filename", "path", "run_id")
    xmp = F.concat(F.lit("<x>"), F.col("run_id").cast("string"), F.lit("</x>"))
    chunks = [key("prompt", "tEXt", F.hex(F.encode("filename", "ISO-8859-1"))), key("Comment", "iTXt", F.concat(F.lit("0000"), _text("en"), F.lit("0000"), _text(F.col("path")))), key("XML:com.adobe.xmp", "iTXt", F.concat(F.lit("00000000"), _text(xmp))), F.when(F.col("id") % 3 == 0, png_chunk("caBX", _text(F.col("filename")))).otherwise("")]
    rows = files.select("id", F.unhex(png(F.lit(4), F.lit(3), F.lit(2), *chunks)).alias("content"))
    rows = rows.select("id", media_bytes.png_text(F.col("content")).alias("t"), media_bytes.xmp_packet(F.col("content")).alias("xmp"), media_bytes.c2pa_manifest(F.col("content")).alias("c2pa"))
    return rows.select("id", F.col("t.prompt").alias("prompt"), F.col("t.Comment").alias("comment"), "xmp", F.hex("c2pa").alias("c2pa"))


@query(f"WITH {FILES} SELECT id, '<x>' || run_id || '</x>' AS xmp, hex('jumbc2pa' || filename) AS c2pa FROM files")
def jpeg_segments(spark, folder):
    """XMP packet and C2PA manifest of JPEG files, the manifest put together from two segments."""
    files = latest_files(spark, folder, "filename", "run_id")
    xmp = F.concat(_text("http://ns.adobe.com/xap/1.0/"), F.lit("00"), _text(F.concat(F.lit("<x>"), F.col("run_id").cast("string"), F.lit("</x>"))))
    box = lambda number, body: jpeg_segment("EB", F.concat(F.lit("4A50"), _hex(7, 4), _hex(number, 8), body))
    rows = files.select("id", F.unhex(jpeg(F.lit(4), F.lit(3), F.lit(3), jpeg_segment("E1", xmp), box(1, _text("jumbc2pa")), box(2, _text(F.col("filename"))))).alias("content"))
    return rows.select("id", media_bytes.xmp_packet(F.col("content")).alias("xmp"), F.hex(media_bytes.c2pa_manifest(F.col("content"))).alias("c2pa"))


@query(f"WITH {FILES} SELECT id, CASE WHEN id % 5 > 0 THEN 'LIVE-' || run_id || '-' || id // 2 END AS identifier FROM files")
def maker_notes(spark, folder):
    """The identifier of a live photo from the maker note of a JPEG; blank ones are none."""
    files = latest_files(spark, folder, "run_id")
    label = F.when(F.col("id") % 5 > 0, F.concat(F.lit("LIVE-"), F.col("run_id").cast("string"), F.lit("-"), F.floor(F.col("id") / 2).cast("string"))).otherwise("   ")
    body = F.concat(_text(label), F.lit("00"))
    note = F.concat(_text("Apple iOS"), F.lit("00"), F.lit("0001"), _text("MM"), _hex(1, 4), _hex(0x0011, 4), _hex(2, 4), _hex(_size(body), 8), F.when(_size(body) > 4, _hex(32, 8)).otherwise(F.rpad(body, 8, "0")), F.lit("00000000"), F.when(_size(body) > 4, body).otherwise(""))
    block = F.concat(_text("Exif"), F.lit("0000"), tiff([], [(0x927C, 7, _size(note), note)]))
    rows = files.select("id", F.unhex(jpeg(F.lit(4), F.lit(3), F.lit(3), jpeg_segment("E1", block))).alias("content"))
    return rows.select("id", text.normalize_identifier(media_bytes.maker_note_tags(F.col("content"))["Tag 0x0011"]).alias("identifier"))


_HEADS = (
    ("FFD8FFE0", "image"), ("89504E470D0A1A0A", "image"), ("474946383961", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("424D", "image"), ("52494646000000005745425056503858", "image"), ("0000001866747970686569630000", "image"),
    ("00000018667479704D344120", "audio"), ("000000186674797069736F6D", "video"), ("1A45DFA3", "video"), ("5249464600000000415649204C495354", "video"), ("000001BA", "video"), ("494433", "audio"), ("FFFB9064", "audio"), ("664C6143", "audio"), ("4F676753", "audio"),
    ("524946460000000057415645666D7420", "audio"), ("00000000", None), ("", None),
)


@query(f"WITH {FILES} SELECT [{', '.join(repr(k) if k else 'NULL' for _, k in _HEADS)}][(id % {len(_HEADS)}) + 1] AS kind, count(*) AS n FROM files GROUP BY 1")
def magic_bytes(spark, folder):
    """Media types by the first bytes of a file."""
    head = F.get(F.array(*[F.lit(h) for h, _ in _HEADS]), (F.col("id") % len(_HEADS)).cast("int"))
    return latest_files(spark, folder).groupBy(text.sniff(F.unhex(F.concat(head, F.lit("00" * 8)))).alias("kind")).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT unnest(['1','L','LA','La','P','PA','RGB','RGBX','RGBA','RGBa','CMYK','YCbCr','LAB','HSV','I;16','I;16L','I;16B','I;16N','I','F']) AS mode), k AS (SELECT DISTINCT color_mode AS mode FROM media_metadata) SELECT mode, CASE WHEN mode = '1' THEN 1 WHEN mode IN ('I', 'F') THEN 32 WHEN starts_with(mode, 'I;16') THEN 16 WHEN mode IN (FROM m) THEN 8 END AS depth, mode IN ('RGBA', 'LA', 'PA', 'RGBa', 'La') AS alpha FROM (FROM m UNION FROM k)")
def mode_depths(spark, folder):
    """Bits per channel and alpha of every known colour mode and of those in the table."""
    known = spark.createDataFrame([(m,) for m in media_bytes.MODE_DEPTHS], "mode string")
    rows = known.unionByName(table(spark, folder, "media_metadata", "color_mode").withColumnRenamed("color_mode", "mode")).distinct()
    return rows.select("mode", media_bytes.mode_depth(F.col("mode")).alias("depth"), media_bytes.mode_alpha(F.col("mode"), F.lit(False)).alias("alpha"))


# ---------------------------------------------------------------- pixels

_PIXELS = "p AS (SELECT vec_id, [greatest(0, least(255, round((x::DOUBLE + 0.5) * 255)))::INT FOR x IN embedding] AS px FROM embeddings)"


def _pixels(spark, folder, height: int = 8, width: int = 8) -> DataFrame:
    """(vec_id, image): every vector's first height x width values as a gray picture."""
    level = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x.cast("double") + 0.5) * 255).cast("int"))))
    data = F.unhex(F.array_join(F.transform(F.slice(level, 1, height * width), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    image = F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    return table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", image.alias("image"))


_BITS = "lower(lpad(hex(list_sum([CASE WHEN {bit} THEN (2::HUGEINT ** ({n} - i))::HUGEINT ELSE 0::HUGEINT END FOR i IN range(1, {m})])::UBIGINT), {digits}, '0'))"


@query("WITH " + _PIXELS + ", s AS (SELECT vec_id, px, list_sum(px) AS total, list_sort(px) AS o FROM p) SELECT vec_id, 'ahash:8:' || " + _BITS.format(bit="px[i] * 64 > total", n=64, m=65, digits=16) + " AS ahash, 'whash:8:' || " + _BITS.format(bit="2 * px[i] > o[32] + o[33]", n=64, m=65, digits=16) + " AS whash FROM s")
def pixel_hashes(spark, folder):
    """Average and wavelet hash of pictures that are as large as the hash."""
    return _pixels(spark, folder).select("vec_id", images.perceptual_hash(F.col("image"), "ahash").alias("ahash"), images.perceptual_hash(F.col("image"), "whash").alias("whash"))


@query("WITH " + _PIXELS + " SELECT vec_id, 'dhash:7:' || " + _BITS.format(bit="px[(i - 1) // 7 * 8 + (i - 1) % 7 + 2] > px[(i - 1) // 7 * 8 + (i - 1) % 7 + 1]", n=49, m=50, digits=13) + " AS dhash FROM p")
def gradient_hashes(spark, folder):
    """Difference hash of side 7 of pictures of 7 x 8 pixels."""
    return _pixels(spark, folder, 7, 8).select("vec_id", images.perceptual_hash(F.col("image"), "dhash", 7).alias("dhash"))


@query("WITH " + _PIXELS + """,
  d AS (SELECT vec_id, v, h, sum(px[r * 8 + k + 1] * cos(pi() * v * (2 * r + 1) / 16) * cos(pi() * h * (2 * k + 1) / 16)) AS value
    FROM p, range(8) a(r), range(8) b(k), range(2) e(v), range(2) f(h) GROUP BY vec_id, v, h),
  m AS (SELECT vec_id, median(value) AS mid FROM d GROUP BY vec_id)
  SELECT vec_id, 'phash:2:' || lower(hex(sum(CASE WHEN value > mid THEN 2 ** (3 - v * 2 - h) ELSE 0 END)::UBIGINT)) AS phash FROM d JOIN m USING (vec_id) GROUP BY vec_id
""")
def frequency_hashes(spark, folder):
    """Perceptual hash of side 2: the lowest cosine coefficients of pictures of 8 x 8 pixels against their median."""
    return _pixels(spark, folder).select("vec_id", images.perceptual_hash(F.col("image"), "phash", 2).alias("phash"))


@query("WITH " + _PIXELS + """,
  l AS (SELECT vec_id, px[(r - 1) * 8 + k + 1] + px[(r + 1) * 8 + k + 1] + px[r * 8 + k] + px[r * 8 + k + 2] - 4 * px[r * 8 + k + 1] AS v FROM p, range(1, 7) a(r), range(1, 7) b(k)),
  q AS (SELECT vec_id, sign(v) * least(floor(abs(v) / 4 + 0.5), 255) AS q FROM l)
  SELECT vec_id, round(var_pop(q) * 16, 6) AS sharpness FROM q GROUP BY vec_id
""")
def pixel_sharpness(spark, folder):
    """Variance of the Laplacian."""
    return _pixels(spark, folder).select("vec_id", F.round(images.sharpness(F.col("image")), 6).alias("sharpness"))


@query("WITH " + _PIXELS + ", n AS (SELECT vec_id, c, count(*) AS n FROM (SELECT vec_id, unnest(px) AS c FROM p) GROUP BY ALL) SELECT vec_id, sum(n)::BIGINT AS total_pixels, count(*) AS distinct_colors, max(n) / sum(n) AS dominant_pixel_ratio, count(*) > 60 AS exceeds_max FROM n GROUP BY vec_id")
def pixel_palette(spark, folder):
    """Colours of a picture: how many, the share of the commonest, and whether there are more than a bound."""
    return _pixels(spark, folder).select("vec_id", images.palette(F.col("image"), most=60).alias("c")).select("vec_id", "c.*")


# ---------------------------------------------------------------- probes and dispatch


def _payload(seconds: str = "duration_seconds") -> Column:
    """What a probing program prints for a row of media_metadata."""
    t = lambda c: F.col(c).cast("string")
    video = F.struct(F.lit("video").alias("codec_type"), F.col("codec").alias("codec_name"), t("width").alias("width"), t("height").alias("height"), F.lit("N/A").alias("duration"), F.concat((F.col("frame_rate") * 1000).cast("bigint").cast("string"), F.lit("/1000")).alias("avg_frame_rate"), F.lit("0/0").alias("r_frame_rate"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.col("codec").alias("codec_name"), t("sample_rate").alias("sample_rate"), t("channels").alias("channels"))
    box = F.struct(t(seconds).alias("duration"), t("bitrate").alias("bit_rate"), F.create_map(F.lit("ENCODER"), F.lit("x"), F.lit("creation_time"), F.lit("2024-05-06T07:08:09Z")).alias("tags"))
    both = lambda streams: F.to_json(F.struct(streams.alias("streams"), box.alias("format")))
    return F.when(F.col("width").isNotNull(), both(F.array(F.from_json(F.to_json(video), "map<string,string>"), F.from_json(F.to_json(audio), "map<string,string>")))).otherwise(both(F.array(F.from_json(F.to_json(audio), "map<string,string>"))))


_VIDEO = "media_metadata WHERE width IS NOT NULL AND duration_seconds IS NOT NULL"
_PROBED = ["width", "height", "duration_seconds", "codec", "bitrate", "frame_rate", "sample_rate", "channels"]


@query(f"SELECT DISTINCT file_id, width, height, duration_seconds, codec, bitrate, CASE WHEN frame_rate > 0 THEN round((frame_rate * 1000)::DOUBLE, 3)::BIGINT / 1000 END AS frame_rate, sample_rate, channels, epoch_us(TIMESTAMPTZ '2024-05-06 07:08:09Z') AS captured FROM {_VIDEO}")
def probe_video(spark, folder):
    """Video metadata from a probe's JSON; what the stream lacks comes from the container."""
    rows = _metadata(spark, folder, *_PROBED).where("width IS NOT NULL AND duration_seconds IS NOT NULL").select("file_id", probes.video_metadata(_payload()).alias("v"))
    return rows.select("file_id", *[F.col(f"v.{c}").alias(c) for c in _PROBED], F.unix_micros("v.captured_at").alias("captured"))


@query("SELECT DISTINCT file_id, duration_seconds, codec, bitrate, sample_rate, channels, 'x' AS encoder FROM media_metadata WHERE width IS NULL AND sample_rate IS NOT NULL")
def probe_audio(spark, folder):
    """Audio metadata and container tags from a probe's JSON."""
    rows = _metadata(spark, folder, *_PROBED).where("width IS NULL AND sample_rate IS NOT NULL").withColumn("payload", _payload())
    rows = rows.select("file_id", probes.audio_metadata(F.col("payload")).alias("a"), probes.container_tags(F.col("payload"))["encoder"].alias("encoder"))
    return rows.select("file_id", *[F.col(f"a.{c}").alias(c) for c in ("duration_seconds", "codec", "bitrate", "sample_rate", "channels")], "encoder")


@query(f"WITH {FILES} SELECT id, run_id::VARCHAR AS year, 'a, ' || filename AS artist FROM files")
def audio_tag_map(spark, folder):
    """Tags with lower-case keys, aliases and joined lists."""
    tags = F.create_map(F.lit("Date"), F.array(F.col("run_id").cast("string")), F.lit("ARTIST"), F.array(F.lit("a"), F.col("filename")))
    return latest_files(spark, folder, "run_id", "filename").select("id", probes.audio_tags(tags).alias("t")).select("id", F.col("t.year").alias("year"), F.col("t.artist").alias("artist"))


@query(f"""
  WITH {FILES}, m AS (SELECT file_id, max(width) AS w, max(height) AS h, max(duration_seconds) AS d, max(codec) AS c FROM media_metadata GROUP BY 1),
  f AS (SELECT id, path, media_type, w, h, d, c, CASE WHEN size_bytes <= 0 THEN 'empty file' WHEN media_type = 'image' AND (w IS NULL OR h IS NULL) THEN 'unsupported or corrupt image' WHEN media_type <> 'image' AND file_id IS NULL THEN 'no probe output' END AS error FROM files LEFT JOIN m ON file_id = id)
  SELECT id, error, CASE WHEN error IS NULL AND media_type <> 'audio' THEN w END AS width, CASE WHEN error IS NULL AND (media_type = 'image' OR media_type = 'video' AND w IS NOT NULL) THEN h END AS height,
    CASE WHEN error IS NULL AND media_type <> 'image' THEN d END AS duration_seconds, CASE WHEN error IS NULL AND (media_type = 'audio' OR media_type = 'video' AND w IS NOT NULL) THEN c END AS codec, CASE WHEN error IS NULL AND media_type = 'image' THEN CASE WHEN id % 4 = 0 THEN upper(regexp_extract(filename, '\\.([^.]+)$', 1)) ELSE 'PNG' END END AS image_format
  FROM f JOIN (SELECT id, filename FROM files) USING (id)
""")
def metadata_dispatch(spark, folder):
    """Metadata by media type: pictures from their bytes (every fourth has no header, only EXIF), others from the probe, and what went wrong."""
    meta = table(spark, folder, "media_metadata", "file_id", *_PROBED).groupBy(F.col("file_id").alias("id")).agg(*[F.max(c).alias(c) for c in _PROBED])
    rows = latest_files(spark, folder, "path", "media_type", "size_bytes").join(meta.withColumn("known", F.lit(True)), "id", "left")
    w, h = F.col("width"), F.col("height")
    bare = F.concat(F.lit("FFD8"), jpeg_segment("E1", F.concat(_text("Exif"), F.lit("0000"), tiff([], [(0xA002, 4, 1, _little(w, 8)), (0xA003, 4, 1, _little(h, 8))]))), F.lit("FFDA"))
    content = F.when(w.isNotNull() & h.isNotNull(), F.unhex(F.when(F.col("id") % 4 == 0, bare).otherwise(png(w, h, F.lit(2))))).otherwise(F.unhex(F.lit("00")))
    found = sources.extract(rows.select(F.concat_ws("#", F.col("id").cast("string"), "path").alias("path"), F.col("size_bytes").alias("size"), "media_type", content.alias("content"), F.when(F.col("known"), _payload()).alias("payload")))
    return found.select(F.substring_index("path", "#", 1).cast("bigint").alias("id"), "error", "metadata.width", "metadata.height", "metadata.duration_seconds", "metadata.codec", "metadata.image_format")


@query(f"WITH {FILES} SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN TIMESTAMP '2020-01-02 03:04:05' ELSE TIMESTAMP '2021-01-01 00:00:00' END AS captured FROM files")
def capture_priority(spark, folder):
    """The first tag that holds a time."""
    first = F.when(F.col("id") % 3 == 1, "2020:01:02 03:04:05").when(F.col("id") % 3 == 2, "not a time")
    second = F.when(F.col("id") % 3 == 0, "0000:00:00 00:00:00").otherwise("2021:01:01 00:00:00")
    return latest_files(spark, folder).select("id", dates.capture_time(first, second).alias("captured"))
