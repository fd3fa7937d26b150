"""Names, paths and labels as column expressions."""

from __future__ import annotations

import mimetypes
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stratalens.errors import SecurityError
from stratalens.functions.hashing import trim_all

# Raw camera extensions that count as images.
RAW_EXTENSIONS = ("3fr", "ari", "arw", "cr2", "cr3", "dcr", "dng", "erf", "k25", "kdc", "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "rwl", "sr2", "srf", "srw", "x3f")
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def path_key(path: Column) -> Column:
    """Sorts as paths do: component by component."""
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def stem(path: Column) -> Column:
    """The last component without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+\z", "")


def normalize_extension(text: Column) -> Column:
    """The lower-case suffix of the last component; a bare token without dot or slash is itself one; else empty."""
    t = F.replace(trim_all(text), F.lit("\\"), F.lit("/"))
    last = F.substring_index(t, "/", -1)
    suffix = F.regexp_extract(last, r"\A.+\.([^.]+)\z", 1)
    bare = ~t.contains("/") & ~last.contains(".")
    hidden = F.when(~t.contains("/") & last.rlike(r"\A\.[^.]+\z"), F.substring(last, 2, 1 << 20)).otherwise("")
    return F.lower(F.when(suffix != "", suffix).when(bare, last).otherwise(hidden))


def format_of(path: Column) -> Column:
    """The image format that a suffix names, in upper case; null without a suffix."""
    return F.nullif(F.upper(F.regexp_extract(basename(path), r"\A.+\.([^.]+)\z", 1)), F.lit(""))


def name_types() -> dict[str, str]:
    """extension -> image, video or audio, from the MIME table shipped with Python and the raw supplement."""
    table = mimetypes.MimeTypes(filenames=())
    known = {ext[1:]: kind.split("/")[0] for types in table.types_map for ext, kind in types.items() if kind.split("/")[0] in ("image", "video", "audio")}
    return known | dict.fromkeys(RAW_EXTENSIONS, "image") | {"webp": "image", "heic": "image", "heif": "image", "mkv": "video"} | dict.fromkeys(("flac", "opus", "ogg", "m4a", "aac", "wma"), "audio")


def media_type(extension: Column, sniffed: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """Override by extension, else what the bytes say, else the name; null if none knows."""
    lookup = lambda table: F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])[extension]
    choices = [lookup(overrides)] if overrides else []
    return F.coalesce(*choices, *([sniffed] if sniffed is not None else []), lookup(name_types()))


def sniff(content: Column) -> Column:
    """image, video or audio by magic bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 16))
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    ftyp = F.substring(head, 9, 8) == "66747970"
    riff = F.when(head.startswith("52494646"), F.decode(F.substring(content, 9, 4), "ISO-8859-1"))
    return (
        F.when(head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A") | head.startswith("47494638") | head.startswith("49492A00") | head.startswith("4D4D002A") | head.startswith("424D") | (riff == "WEBP"), "image")
        .when(ftyp & brand.isin("heic", "heix", "mif1", "avif", "crx "), "image")
        .when(ftyp & brand.isin("M4A ", "M4B "), "audio")
        .when(ftyp | head.startswith("1A45DFA3") | (riff == "AVI ") | head.startswith("000001BA") | head.startswith("3026B2758E66CF11"), "video")
        .when(head.startswith("494433") | head.startswith("FFFB") | head.startswith("664C6143") | head.startswith("4F676753") | (riff == "WAVE"), "audio")
    )


def normalize_identifier(text: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(trim_all(text), F.lit(""))


def plan_directory(folder: Column, dated: Column, keep_dated: Column) -> Column:
    """folder/dated, folder alone, or dated where no folder is given."""
    return F.when(folder.isNull(), dated).when(keep_dated, F.concat_ws("/", folder, dated)).otherwise(folder)


def issue_text(step: Column, path: Column, message: Column) -> Column:
    return F.concat_ws(": ", step, path, message)


def format_size(size: Column) -> Column:
    """Bytes with one decimal in binary units; ties go to the even digit. Negative sizes give null."""
    power = F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 10), F.lit(len(UNITS) - 1)).cast("int")
    power = F.when(size >= F.pow(F.lit(1024.0), (power + 1).cast("double")), F.least(power + 1, F.lit(len(UNITS) - 1))).otherwise(power)
    scaled = size / F.pow(F.lit(1024.0), power.cast("double"))
    number = F.bround(scaled.cast("decimal(38,12)"), 1).cast("string")
    label = F.element_at(F.array(*map(F.lit, UNITS)), power + 1)
    return F.when(size < 0, None).when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat_ws(" ", number, label))


def clean_filename(name: str | None, limit: int = 255) -> str | None:
    """A safe single path component: NFC, separators and control characters replaced, trimmed, at most `limit` bytes."""
    if name is None:
        return None
    safe = "".join("_" if c in "/\\\0" or unicodedata.category(c) in ("Cc", "Cf") else c for c in unicodedata.normalize("NFC", name))
    safe = safe.strip().strip(".").strip()
    raw = safe.encode("utf-8", "replace")
    if len(raw) > limit:
        safe = raw[:limit].decode("utf-8", "ignore").rstrip(". ")
    return safe or None


def sanitize_filename(name: str) -> str:
    if not (safe := clean_filename(name)):
        raise SecurityError("nothing is left of the file name", operation="sanitize_filename")
    return safe


def sanitized(name: Column) -> Column:
    """clean_filename over a column, in Arrow batches; what can't be made safe gives null."""

    def clean(names: pd.Series) -> pd.Series:
        return names.map(clean_filename, na_action="ignore")

    return F.pandas_udf(clean, StringType())(name)


def check_folder_name(name: str) -> None:
    if not name or name != name.strip() or re.search(r"[/\\\x00-\x1f]", name) or name in (".", "..") or re.match(r"\d{4}\Z", name):
        raise SecurityError(f"not a safe folder name: {name!r}")
