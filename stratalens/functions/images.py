"""Pixels: perceptual hashes, sharpness and palettes as Arrow-batched functions over Spark's image struct.

The struct holds BGR(A) or gray bytes (OpenCV modes). Hashes keep the usual structure (side squared bits, row major,
first bit highest); the resampling is area averaging, so bits may differ from other libraries on single pixels.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions.hashing import check_perceptual

COLORS = T.StructType([T.StructField("total_pixels", T.LongType()), T.StructField("distinct_colors", T.LongType()), T.StructField("dominant_pixel_ratio", T.DoubleType()), T.StructField("exceeds_max", T.BooleanType())])


def stored(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """height x width x channels in the order of the struct, BGR(A); null for images that couldn't be decoded."""
    if pd.isna(height) or pd.isna(width) or height <= 0 or width <= 0 or not data:
        return None
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels))


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """The same in RGB(A) order."""
    array = stored(height, width, channels, data)
    if array is None:
        return None
    return array if channels == 1 else array[..., [2, 1, 0, *range(3, channels)]]


def gray(array: np.ndarray) -> np.ndarray:
    """Luma of the broadcast standard, rounded to bytes."""
    if array.shape[2] == 1:
        return array[..., 0]
    rgb = array[..., :3].astype(np.uint32)
    return ((rgb[..., 0] * 19595 + rgb[..., 1] * 38470 + rgb[..., 2] * 7471 + 0x8000) >> 16).astype(np.uint8)


_LOW_BYTES = np.uint64(0x00FF00FF00FF00FF)
_EIGHT = np.uint64(8)
#: Luma of the broadcast standard for channels in RGB(A) and BGR(A) order.
RGB_LUMA, BGR_LUMA = (19595, 38470, 7471, 0), (7471, 38470, 19595, 0)


@lru_cache(64)
def _weights(src: int, dst: int) -> np.ndarray:
    """dst x src: the share of each source cell in each target cell."""
    edges = np.linspace(0, src, dst + 1)
    cells = np.arange(src)
    overlap = np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None)
    return overlap / overlap.sum(1, keepdims=True)


def _row_means(flat: np.ndarray, height: int) -> np.ndarray:
    """The lines of a byte matrix area-averaged to `height` lines.

    Eight bytes are added at a time, in 16-bit lanes of 64-bit words that at most 257 lines can't overflow; only the
    lines that a target cell shares with the next one are weighted.
    """
    src, width = flat.shape
    if src < 2 * height:
        return _weights(src, height) @ flat
    if width % 8:
        flat = np.pad(flat, ((0, 0), (0, -width % 8)))
    words, edges = np.ascontiguousarray(flat).view(np.uint64), np.linspace(0, src, height + 1)
    out = np.empty((height, flat.shape[1]))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        first, last = int(np.ceil(a)), int(b)
        total = np.zeros(flat.shape[1], np.int64)
        for start in range(first, last, 64):
            block = words[start : min(last, start + 64)]
            total[0::2] += np.add.reduce(block & _LOW_BYTES, 0).view(np.uint16)
            total[1::2] += np.add.reduce((block >> _EIGHT) & _LOW_BYTES, 0).view(np.uint16)
        line = out[i]
        line[:] = total
        if first > a:
            line += (first - a) * flat[first - 1]
        if b > last and last < src:
            line += (b - last) * flat[last]
        line /= b - a
    return out[:, :width]


def resized(image: np.ndarray, height: int, width: int, luma: tuple[int, ...] = RGB_LUMA) -> np.ndarray:
    """Area-averaged to height x width; pictures with channels come out as luma, which is taken of the averaged lines."""
    channels = image.shape[2] if image.ndim == 3 else 1
    lines = _row_means(image.reshape(image.shape[0], -1), height)
    if channels > 1:
        lines = lines.reshape(height, -1, channels) @ (np.array(luma[:channels]) / 65536)
    return lines @ _weights(image.shape[1], width).T


@lru_cache(8)
def _cosine(n: int) -> np.ndarray:
    k, x = np.mgrid[:n, :n]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def hash_bits(image: np.ndarray, algorithm: str, side: int, luma: tuple[int, ...] = RGB_LUMA) -> np.ndarray:
    """The side x side bits of a gray or coloured image."""
    if algorithm == "ahash":
        small = resized(image, side, side, luma)
        return small > small.mean()
    if algorithm == "dhash":
        small = resized(image, side, side + 1, luma)
        return small[:, 1:] > small[:, :-1]
    if algorithm == "phash":
        n = side * 4
        basis = _cosine(n)[:side]
        low = basis @ resized(image, n, n, luma) @ basis.T
        return low > np.median(low)
    # the low band of a Haar transform is a scaled mean of blocks, so it is the area average itself
    small = resized(image, side, side, luma) / 255
    small = small - small.mean()
    return small > np.median(small)


def perceptual_hex(image: np.ndarray, algorithm: str, side: int, luma: tuple[int, ...] = RGB_LUMA) -> str:
    bits = np.packbits(hash_bits(image, algorithm, side, luma).ravel())
    digits = -(-side * side // 4)
    return f"{int.from_bytes(bits.tobytes()) >> (-side * side) % 8:0{digits}x}"


def sharpness_of(image: np.ndarray) -> float:
    """Variance of the Laplacian, whose response is divided by four and rounded per pixel and polarity, times sixteen."""
    wide = image.astype(np.int32)
    response = np.zeros_like(wide)
    if min(image.shape) > 2:
        response = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * wide[1:-1, 1:-1]
    quarter = np.sign(response) * np.minimum(np.floor(np.abs(response) / 4 + 0.5), 255)
    return float(max(quarter.var(), 0.0) * 16)


def color_counts(array: np.ndarray, sample: int = 256, most: int = 65_536) -> tuple[int, int, float, bool]:
    """Pixels, distinct colours and the share of the commonest, after nearest-neighbour reduction to `sample`."""
    longest = max(array.shape[:2])
    if longest > sample:
        h, w = (max(1, round(n * sample / longest)) for n in array.shape[:2])
        rows, columns = ((np.arange(n) + 0.5) * size / n for n, size in ((h, array.shape[0]), (w, array.shape[1])))
        array = array[rows.astype(int)][:, columns.astype(int)]
    rgb = np.repeat(array, 3, 2) if array.shape[2] == 1 else array[..., :3]
    codes = (rgb.astype(np.uint32) * np.array([65536, 256, 1], np.uint32)).sum(2).ravel()
    _, counts = np.unique(codes, return_counts=True)
    return len(codes), len(counts), float(counts.max() / len(codes)), len(counts) > most


def _apply(image: Column, kind: T.DataType, work, as_stored: bool = False) -> Column:
    def batch(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series):
        arrays = ((stored if as_stored else pixels)(*row) for row in zip(height, width, channels, data, strict=True))
        values = [None if a is None else work(a) for a in arrays]
        return pd.DataFrame([v or (None,) * len(kind) for v in values], columns=kind.names) if isinstance(kind, T.StructType) else pd.Series(values)

    batch.__annotations__ = dict.fromkeys(("height", "width", "channels", "data"), pd.Series) | {"return": pd.DataFrame if isinstance(kind, T.StructType) else pd.Series}
    return F.pandas_udf(batch, kind)(image["height"], image["width"], image["nChannels"], image["data"])


def perceptual_hash(image: Column, algorithm: str = "phash", side: int = 8) -> Column:
    """algorithm:side:hex of an image struct; null for undecodable images."""
    check_perceptual(algorithm, side)
    return _apply(image, T.StringType(), lambda a: f"{algorithm}:{side}:{perceptual_hex(a, algorithm, side, BGR_LUMA)}", as_stored=True)


def sharpness(image: Column) -> Column:
    return _apply(image, T.DoubleType(), lambda a: sharpness_of(gray(a)))


def palette(image: Column, sample: int = 256, most: int = 65_536) -> Column:
    return _apply(image, COLORS, lambda a: color_counts(a, sample, most))
