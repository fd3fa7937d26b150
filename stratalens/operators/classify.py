"""Screenshots, graphics and generated images by weighted signals, and the folders they go to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions.text import basename, check_folder_name

# Fixed values of the detectors: patterns, markers, ratios and tags.
SCREENSHOT_NAMES = (r"screen[\s_-]?shot", r"screen[\s_-]?capture", r"scr(?:n|een)?cap\b", r"\bcapture[\s_-]?d?[\s_-]?ecran")
CAPTURE_TOOLS = (
    "screenshot", "screen shot", "screencapture", "screencap", "snipping tool", "snip & sketch", "gnome-screenshot", "spectacle", "flameshot", "greenshot", "lightshot", "shutter",
)
DISPLAY_RATIOS = ((5, 4), (4, 3), (3, 2), (16, 10), (16, 9), (19, 9), (13, 6), (20, 9), (43, 18), (64, 27))
PROMPT_KEYS = ("parameters", "prompt", "workflow", "sd-metadata", "Dream", "invokeai_metadata")
GENERATORS = (
    "midjourney", "dall-e", "dall·e", "stable diffusion", "stablediffusion", "adobe firefly", "novelai", "leonardo.ai", "ideogram", "google imagen", "flux.1", "comfyui", "automatic1111", "fooocus",
)
C2PA_AI_SOURCES = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia")
CAMERA_TAGS = ("Make", "Model", "LensModel", "LensMake", "FNumber", "ExposureTime", "ISOSpeedRatings", "PhotographicSensitivity", "FocalLength", "DateTimeOriginal")


@dataclass(frozen=True)
class Screenshots:
    filename: float = 0.6
    software: float = 0.8
    dimension: float = 0.3
    threshold: float = 0.5
    tools: tuple[str, ...] = CAPTURE_TOOLS
    ratios: tuple[tuple[int, int], ...] = DISPLAY_RATIOS
    tolerance: float = 0.01
    min_edge: int = 720
    extra: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class Generated:
    c2pa: float = 0.9
    chunk: float = 0.8
    marker: float = 0.8
    threshold: float = 0.5
    keys: tuple[str, ...] = PROMPT_KEYS
    markers: tuple[str, ...] = GENERATORS


@dataclass(frozen=True)
class Graphics:
    camera: float = 0.7
    alpha: float = 0.4
    histogram: float = 0.5
    max_colors: int = 256
    flat_ratio: float = 0.35
    tags: tuple[str, ...] = CAMERA_TAGS


@dataclass(frozen=True)
class Routing:
    enabled: bool = True
    min_confidence: float = 0.75
    keep_dated: bool = True
    folders: dict[str, str] = field(default_factory=lambda: {"screenshot": "Screenshots", "graphic": "Graphics", "live_photo": "LivePhotos", "ai_generated": "AI-Generated", "review": "Review", "duplicate": "Duplicates"})

    def __post_init__(self) -> None:
        for name in self.folders.values():
            check_folder_name(name)
        if len({n.casefold() for n in self.folders.values()}) < len(self.folders):
            raise ValueError("two categories share a folder")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def screenshot_name(name: Column) -> Column:
    return _yes(basename(name).rlike("(?i)" + "|".join(f"(?:{p})" for p in SCREENSHOT_NAMES)))


def capture_tool(software: Column, tools: tuple[str, ...] = CAPTURE_TOOLS) -> Column:
    """The value is folded, the markers are taken as given."""
    return _yes(F.exists(F.array(*map(F.lit, tools)), lambda m: F.contains(F.lower(software), m)))


def screen_size(width: Column, height: Column, config: Screenshots | None = None) -> Column:
    """A display's aspect ratio at a screen's size, or an extra resolution in either orientation."""
    c = config or Screenshots()
    long, short = F.greatest(width, height), F.least(width, height)
    q = long / F.nullif(short, F.lit(0))
    near = F.exists(F.array(*[F.lit(a / b) for a, b in c.ratios]), lambda r: F.abs(q - r) <= r * c.tolerance)
    extra = F.lit(False)
    for a, b in c.extra:
        extra = extra | ((long == max(a, b)) & (short == min(a, b)))
    return _yes((width > 0) & (height > 0) & (extra | (near & (short >= c.min_edge))))


def screenshot(name: Column, software: Column, width: Column, height: Column, config: Screenshots | None = None) -> Column:
    """struct(is_screenshot, confidence, by_name, by_software, by_size)."""
    c = config or Screenshots()
    signals = [screenshot_name(name), capture_tool(software, c.tools), screen_size(width, height, c)]
    points = [F.when(s, w).otherwise(0.0) for s, w in zip(signals, (c.filename, c.software, c.dimension), strict=True)]
    confidence = F.least(F.lit(1.0), points[0] + points[1] + points[2])
    return F.struct((confidence >= c.threshold).alias("is_screenshot"), confidence.alias("confidence"), *[s.alias(n) for s, n in zip(signals, ("by_name", "by_software", "by_size"), strict=True)])


def prompt_key(chunks: Column, keys: tuple[str, ...] = PROMPT_KEYS) -> Column:
    """The first text-chunk key, in order, that generators write."""
    return F.get(F.filter(F.array_sort(F.map_keys(chunks)), lambda k: F.lower(k).isin(*[x.casefold() for x in keys])), F.lit(0))


def generator_marker(*texts: Column, markers: tuple[str, ...] = GENERATORS) -> Column:
    """The first marker, in order, that occurs in the texts."""
    joined = F.lower(F.concat_ws("\n", *texts))
    return F.get(F.filter(F.array(*map(F.lit, sorted(markers))), lambda m: F.contains(joined, F.lower(m))), F.lit(0))


def c2pa_ai_source(manifest: Column) -> Column:
    text = F.decode(manifest, "ISO-8859-1")
    return _yes(text.contains(C2PA_AI_SOURCES[0]) | text.contains(C2PA_AI_SOURCES[1]))


def ai_generated(c2pa: Column, chunk_key: Column, marker: Column, config: Generated | None = None) -> Column:
    """struct(is_ai_generated, confidence)."""
    c = config or Generated()
    points = [F.when(s, w).otherwise(0.0) for s, w in ((_yes(c2pa), c.c2pa), (chunk_key.isNotNull(), c.chunk), (marker.isNotNull(), c.marker))]
    confidence = F.least(F.lit(1.0), points[0] + points[1] + points[2])
    return F.struct((confidence >= c.threshold).alias("is_ai_generated"), confidence.alias("confidence"))


def camera_exif(tags: Column, names: tuple[str, ...] = CAMERA_TAGS) -> Column:
    return _yes(F.exists(F.array(*map(F.lit, names)), lambda t: F.coalesce(tags[t], F.lit("")) != ""))


def histogram_side(colors: Column, dominant: Column, exceeds: Column, config: Graphics | None = None) -> Column:
    """photo or graphic by the palette; null without one."""
    c = config or Graphics()
    return F.when(exceeds, "photo").when((colors <= c.max_colors) | (dominant >= c.flat_ratio), "graphic").when(colors.isNotNull(), "photo")


def photo_graphic(camera: Column, alpha: Column, side: Column, config: Graphics | None = None) -> Column:
    """struct(content_type, confidence): the side with more weight; no weight is unknown, a tie is a photo."""
    c = config or Graphics()
    photo = F.when(_yes(camera), c.camera).otherwise(0.0) + F.when(_yes(side == "photo"), c.histogram).otherwise(0.0)
    graphic = F.when(_yes(alpha), c.alpha).otherwise(0.0) + F.when(_yes(side == "graphic"), c.histogram).otherwise(0.0)
    total = photo + graphic
    kind = F.when(total == 0, "unknown").when(photo >= graphic, "photo").otherwise("graphic")
    return F.struct(kind.alias("content_type"), F.when(total == 0, 0.0).otherwise(F.greatest(photo, graphic) / F.nullif(total, F.lit(0.0))).alias("confidence"))


def route(live: Column, ai: Column, shot: Column, graphic: Column, config: Routing | None = None) -> Column:
    """The category of a file by the first rule that holds; null keeps the dated layout. ai, shot and graphic are the structs above."""
    c = config or Routing()
    if not c.enabled:
        return F.lit(None).cast("string")
    is_ai, is_shot, is_graphic = _yes(ai["is_ai_generated"]), _yes(shot["is_screenshot"]), _yes(graphic["content_type"] == "graphic")
    sure = lambda s: _yes(s["confidence"] >= c.min_confidence)
    return F.when(_yes(live), "live_photo").when(is_ai & sure(ai), "ai_generated").when(is_shot & sure(shot), "screenshot").when(is_graphic & sure(graphic), "graphic").when(is_ai | is_shot | is_graphic, "review")


def folder(category: Column, config: Routing | None = None) -> Column:
    c = config or Routing()
    return F.create_map(*[F.lit(x) for kv in c.folders.items() for x in kv])[category]
