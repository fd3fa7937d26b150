"""Metadata inside image files, read from their bytes: sizes, EXIF tags, maker notes, text chunks, XMP, C2PA."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tag numbers of the EXIF standard by name, and bits per channel by color mode.
EXIF_NAMES = {
    0x00FE: "NewSubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model",
    0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x012D: "TransferFunction",
    0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0152: "ExtraSamples", 0x0211: "YCbCrCoefficients", 0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite",
    0x4746: "Rating", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8769: "ExifOffset", 0x8822: "ExposureProgram", 0x8825: "GPSInfo", 0x8827: "ISOSpeedRatings", 0x8830: "SensitivityType", 0x8832: "RecommendedExposureIndex",
    0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue",
    0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectLocation",
    0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized", 0xA000: "FlashPixVersion", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA005: "ExifInteroperabilityOffset",
    0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance",
    0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID",
    0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}
MODE_DEPTHS = {
    "1": 1, "L": 8, "LA": 8, "La": 8, "P": 8, "PA": 8, "RGB": 8, "RGBX": 8, "RGBA": 8, "RGBa": 8, "CMYK": 8, "YCbCr": 8, "LAB": 8, "HSV": 8, "I;16": 16, "I;16L": 16, "I;16B": 16, "I;16N": 16, "I": 32, "F": 32,
}
ALPHA_MODES = ("RGBA", "LA", "PA", "RGBa", "La")
_NUMBERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
HEADER = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("image_format", T.StringType()), T.StructField("color_mode", T.StringType()), T.StructField("bit_depth", T.LongType()), T.StructField("has_alpha", T.BooleanType())])


def png_chunks(data: bytes):
    """(type, content) of every complete chunk."""
    at = len(PNG_MAGIC)
    while data.startswith(PNG_MAGIC) and at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            return
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def jpeg_segments(data: bytes):
    """(marker, content) of the segments before the picture itself."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def header(data: bytes) -> tuple | None:
    """(width, height, format, mode, depth, alpha) of PNG, JPEG, TIFF (and raw pictures built on it), WebP, HEIF, GIF, BMP; null for others and for broken files."""
    try:
        if data.startswith(PNG_MAGIC):
            width, height, depth, kind = struct.unpack(">IIBB", data[16:26])
            mode = {0: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[kind]
            clear = any(t == b"tRNS" for t, _ in png_chunks(data))
            return width, height, "PNG", mode, MODE_DEPTHS[mode], mode in ALPHA_MODES or clear
        if data[:2] == b"\xff\xd8":
            for marker, body in jpeg_segments(data):
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width, parts = struct.unpack(">HHB", body[1:6])
                    mode = {1: "L", 3: "RGB", 4: "CMYK"}[parts]
                    return width, height, "JPEG", mode, 8, False
        if data[:4] in (b"II*\0", b"MM\0*"):
            return tiff_header(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return webp_header(data)
        if data[4:8] == b"ftyp" and (at := data.find(b"ispe", 0, 1 << 16)) > 0:
            return *struct.unpack(">II", data[at + 8 : at + 16]), "HEIF", "RGB", 8, False
        if data[:4] == b"GIF8":
            return *struct.unpack("<HH", data[6:10]), "GIF", "P", 8, False
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height), "BMP", "RGB", 8, False
    except (struct.error, KeyError, IndexError):
        pass
    return None


def tiff_header(data: bytes) -> tuple | None:
    tags = tiff_tags(data)
    if not isinstance(tags.get(0x100), int) or not isinstance(tags.get(0x101), int):
        return None
    bits, samples = tags.get(0x102, 1), tags.get(0x115, 1)
    bits = bits[0] if isinstance(bits, tuple) else bits
    gray = {1: "1", 16: "I;16", 32: "I"}.get(bits, "LA" if samples == 2 else "L")
    mode = {0: gray, 1: gray, 2: "RGBA" if samples == 4 else "RGB", 3: "P", 5: "CMYK", 6: "YCbCr", 8: "LAB"}.get(tags.get(0x106), gray if samples < 3 else "RGB")
    return tags[0x100], tags[0x101], "TIFF", mode, MODE_DEPTHS[mode], mode in ALPHA_MODES


def webp_header(data: bytes) -> tuple | None:
    kind = data[12:16]
    if kind == b"VP8X":
        alpha, width, height = bool(data[20] & 0x10), int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    elif kind == b"VP8L" and data[20] == 0x2F:
        packed = int.from_bytes(data[21:25], "little")
        alpha, width, height = bool(packed >> 28 & 1), (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1
    elif kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        (width, height), alpha = (n & 0x3FFF for n in struct.unpack("<HH", data[26:30])), False
    else:
        return None
    return width, height, "WEBP", "RGBA" if alpha else "RGB", 8, alpha


def tiff_tags(data: bytes) -> dict[int, object]:
    """Tag number -> value of the first directory and its EXIF subdirectory, the first one winning."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    tags: dict[int, object] = {}

    def read(at: int) -> int | None:
        (count,) = struct.unpack_from(f"{order}H", data, at)
        deeper = None
        for i in range(count):
            tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * n
            start = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * i)[0]
            raw = data[start : start + size]
            if tag == 0x8769:
                (deeper,) = struct.unpack_from(f"{order}I", data, at + 10 + 12 * i)
            elif kind in (2, 7):
                tags.setdefault(tag, raw)
            elif kind in _NUMBERS and len(raw) == size and n:
                values = struct.unpack(f"{order}{n}{_NUMBERS[kind]}", raw)
                tags.setdefault(tag, values[0] if n == 1 else values)
            elif kind in (5, 10) and len(raw) == size and n:
                parts = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", raw)
                values = tuple(over / under if under else None for over, under in zip(parts[::2], parts[1::2], strict=True))
                tags.setdefault(tag, values[0] if n == 1 else values)
        return deeper

    if sub := read(struct.unpack_from(f"{order}I", data, 4)[0]):
        read(sub)
    return tags


def exif_block(data: bytes) -> bytes | None:
    for marker, body in jpeg_segments(data):
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            return body[6:]
    return next((body for kind, body in png_chunks(data) if kind == b"eXIf"), data if data[:4] in (b"II*\0", b"MM\0*") else None)


def tag_text(value: object) -> str:
    """Bytes as UTF-8 with replacements, without NUL, trimmed."""
    text = value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    return text.replace("\0", "").strip()


def exif(data: bytes) -> dict[str, str]:
    """All tags, by name or number, without thumbnails, maker notes and empty texts; nothing for files without or with broken EXIF."""
    try:
        block = exif_block(data)
        tags = tiff_tags(block) if block else {}
    except (struct.error, KeyError):
        return {}
    named = {EXIF_NAMES.get(t, str(t)): tag_text(v) for t, v in tags.items() if t != 0x927C and v is not None}
    return {name: text for name, text in named.items() if text}


def apple_maker_note(data: bytes) -> dict[str, str]:
    """"Tag 0xNNNN" -> text of the ASCII and undefined entries of an Apple maker note; broken ones give nothing."""
    try:
        block = exif_block(data)
        note = tiff_tags(block).get(0x927C) if block else None
        if not isinstance(note, bytes) or not note.startswith(b"Apple iOS\0"):
            return {}
        order, out = {b"MM": ">", b"II": "<"}[note[12:14]], {}
        for i in range(struct.unpack_from(f"{order}H", note, 14)[0]):
            tag, kind, size = struct.unpack_from(f"{order}HHI", note, 16 + 12 * i)
            if kind in (2, 7):
                start = 24 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", note, 24 + 12 * i)[0]
                raw = note[start : start + size]
                if len(raw) < size:
                    return {}
                if raw.isascii():
                    out[f"Tag 0x{tag:04X}"] = raw.decode().strip("\0")
        return out
    except (struct.error, KeyError):
        return {}


def text_chunks(data: bytes) -> dict[str, str]:
    """Keyword -> text of a PNG's tEXt, zTXt and iTXt chunks."""
    out: dict[str, str] = {}
    for kind, body in png_chunks(data):
        key, _, rest = body.partition(b"\0")
        try:
            if kind == b"tEXt":
                out[key.decode("latin-1")] = rest.decode("latin-1")
            elif kind == b"zTXt":
                out[key.decode("latin-1")] = zlib.decompress(rest[1:]).decode("latin-1")
            elif kind == b"iTXt":
                packed, (_, _, body_) = rest[0], rest[2:].partition(b"\0")
                text = body_.partition(b"\0")[2]
                out[key.decode("latin-1")] = (zlib.decompress(text) if packed else text).decode("utf-8", "replace")
        except (zlib.error, IndexError):
            continue
    return out


def xmp(data: bytes) -> str | None:
    """The XMP packet of a JPEG or PNG."""
    for marker, body in jpeg_segments(data):
        if marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            return body.split(b"\0", 1)[1].decode("utf-8", "replace")
    return text_chunks(data).get("XML:com.adobe.xmp")


def c2pa(data: bytes) -> bytes | None:
    """The C2PA manifest: a PNG's caBX chunks, or a JPEG's APP11 boxes put together by instance number."""
    if data.startswith(PNG_MAGIC):
        return b"".join(body for kind, body in png_chunks(data) if kind == b"caBX") or None
    boxes: dict[bytes, bytes] = {}
    for marker, body in jpeg_segments(data):
        if marker == 0xEB and body[:2] == b"JP":
            boxes[body[2:4]] = boxes.get(body[2:4], b"") + body[8:]
    return b"".join(b for b in boxes.values() if b"jumb" in b and b"c2pa" in b) or None


def mode_depth(mode: Column) -> Column:
    """Bits per channel of a color mode; null for unknown ones."""
    return F.create_map(*[F.lit(x) for kv in MODE_DEPTHS.items() for x in kv])[mode]


def mode_alpha(mode: Column, transparency: Column) -> Column:
    """Whether a mode has an alpha band, or the file says which color is transparent."""
    return mode.isin(*ALPHA_MODES) | F.coalesce(transparency, F.lit(False))


def _over(content: Column, kind: T.DataType, work) -> Column:
    def batch(values: pd.Series):
        rows = [None if v is None else work(v) for v in values]
        return pd.DataFrame([r or (None,) * len(kind) for r in rows], columns=kind.names) if isinstance(kind, T.StructType) else pd.Series(rows)

    batch.__annotations__ = {"values": pd.Series, "return": pd.DataFrame if isinstance(kind, T.StructType) else pd.Series}
    return F.pandas_udf(batch, kind)(content)


_MAP = T.MapType(T.StringType(), T.StringType())


def image_header(content: Column) -> Column:
    return _over(content, HEADER, header)


def exif_tags(content: Column) -> Column:
    return _over(content, _MAP, exif)


def maker_note_tags(content: Column) -> Column:
    return _over(content, _MAP, apple_maker_note)


def png_text(content: Column) -> Column:
    return _over(content, _MAP, text_chunks)


def xmp_packet(content: Column) -> Column:
    return _over(content, T.StringType(), xmp)


def c2pa_manifest(content: Column) -> Column:
    return _over(content, T.BinaryType(), c2pa)
