"""Pixel functions (F-10, F-11, F-15, F-16, A-18, A-19): numpy inside Arrow-batched UDFs, bits in plain Columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hamming(a: Column, b: Column) -> Column:
    """F-11: differing bits of two 64-bit hashes; signs do not matter."""
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    """F-11: percentage of equal bits."""
    return (64 - hamming(a, b)) / 64.0 * 100.0


def dct_matrix(n: int) -> np.ndarray:
    """Rows of the orthonormal DCT-II: scaled by sqrt(2/n), the first row by 1/sqrt(2) more."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos((2 * i + 1) * k * np.pi / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def hash_bits(low: np.ndarray) -> int:
    """64 coefficients as bits, the first one highest: set where above the median; as a signed 64-bit integer."""
    flat = low.reshape(-1)
    order = np.sort(flat)
    bits = flat > (order[31] + order[32]) / 2
    return int(np.packbits(bits).view(">i8")[0])


def phash(pixels: np.ndarray) -> int:
    """F-10: perceptual hash of a square grey image. Bits run over vertical frequencies inside horizontal ones."""
    m = dct_matrix(len(pixels))
    return hash_bits((m[:8] @ pixels.astype(np.float64) @ m[:8].T).T)


def _square(values) -> np.ndarray:
    flat = np.asarray(values, dtype=np.float64)
    side = int(np.sqrt(len(flat)))
    return flat[: side * side].reshape(side, side)


def by_size(column: pd.Series, function) -> list:
    """A function of stacks of equal-sized square images over a column of pixel arrays; None for null."""
    out = [None] * len(column)
    groups: dict[int, list[int]] = {}
    for i, values in enumerate(column):
        if values is not None:
            groups.setdefault(int(np.sqrt(len(values))), []).append(i)
    for rows in groups.values():
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            for i, value in zip(part, function(np.stack([_square(column.iloc[i]) for i in part])), strict=True):
                out[i] = value
    return out


def phashes(stack: np.ndarray) -> list[int]:
    """F-10 of a stack of images: two matrix products, then 64 bits each."""
    m = dct_matrix(stack.shape[1])[:8]
    low = (m @ stack @ m.T).transpose(0, 2, 1).reshape(len(stack), 64)
    order = np.sort(low, axis=1)
    bits = low > ((order[:, 31] + order[:, 32]) / 2)[:, None]
    return np.packbits(bits, axis=1).view(">i8")[:, 0].tolist()


@F.pandas_udf(T.LongType())
def phash_udf(pixels: pd.Series) -> pd.Series:
    """F-10 over arrays of pixels of square images (8×8 and larger); null for null."""
    return pd.Series(by_size(pixels, phashes), dtype="Int64")


def radial_profile(pixels: np.ndarray) -> np.ndarray:
    """A-19: mean spectral magnitude by rounded distance from the zero frequency; the zero frequency itself is 0."""
    h, w = pixels.shape
    magnitude = np.abs(np.fft.fft2(pixels)) / np.sqrt(h * w)
    dy, dx = np.minimum(np.arange(h), h - np.arange(h)), np.minimum(np.arange(w), w - np.arange(w))
    radius = np.round(np.hypot(dy[:, None], dx[None, :])).astype(int).ravel()
    most = min(w, h) // 2
    count = np.bincount(radius, minlength=most + 1)[: most + 1]
    total = np.bincount(radius, magnitude.ravel(), minlength=most + 1)[: most + 1]
    profile = np.divide(total, count, out=np.zeros(most + 1), where=count > 0)
    profile[0] = 0.0
    return profile


def cliff_scale(pixels: np.ndarray) -> float | None:
    """F-15: inferred scale of an enlarged image: the outermost radius well above the noise, from 0.5; None if native."""
    profile = radial_profile(pixels)
    most = len(profile) - 1
    threshold = max(6 * profile[int(most * 0.9) :].mean(), 0.01 * profile.max())
    loud = np.flatnonzero(profile[1:] >= threshold)
    if not len(loud):
        return None
    scale = (loud[-1] + 1) / most
    return None if scale >= 0.9 else float(np.clip(scale, 0.5, 0.9))


def cliff_scales(stack: np.ndarray) -> list[float | None]:
    """F-15 of a stack of images: one transform and one weighted count for all."""
    n, h, w = stack.shape
    magnitude = np.abs(np.fft.fft2(stack)) / np.sqrt(h * w)
    dy, dx = np.minimum(np.arange(h), h - np.arange(h)), np.minimum(np.arange(w), w - np.arange(w))
    radius = np.round(np.hypot(dy[:, None], dx[None, :])).astype(int).ravel()
    most, width = min(w, h) // 2, int(radius.max()) + 1
    total = np.bincount((np.arange(n)[:, None] * width + radius).ravel(), magnitude.reshape(n, -1).ravel(), minlength=n * width).reshape(n, width)[:, : most + 1]
    count = np.bincount(radius, minlength=width)[: most + 1]
    profile = total / np.maximum(count, 1)
    profile[:, 0] = 0.0
    threshold = np.maximum(6 * profile[:, int(most * 0.9) :].mean(1), 0.01 * profile.max(1))
    loud = profile[:, 1:] >= threshold[:, None]
    scale = (most - loud[:, ::-1].argmax(1)) / most
    return [float(np.clip(s, 0.5, 0.9)) if any_ and s < 0.9 else None for s, any_ in zip(scale, loud.any(1), strict=True)]


@F.pandas_udf(T.DoubleType())
def cliff_scale_udf(pixels: pd.Series) -> pd.Series:
    return pd.Series(by_size(pixels, cliff_scales), dtype="float64")


# Limits of a tile that holds content, and the blur before the Laplacian.
MOST_MEAN, LEAST_DEVIATION, BLUR = 250.0, 5.0, 0.5


def content_crop(pixels: np.ndarray, tile: int) -> np.ndarray:
    """F-16: the first of the centre and nine anchored tiles that holds content, else the centre."""
    h, w = pixels.shape
    spots = [(max(0, (h - tile) // 2), max(0, (w - tile) // 2))]
    spots += [(max(0, min(h - tile, h * qy // 4 - tile // 2)), max(0, min(w - tile, w * qx // 4 - tile // 2))) for qy in (1, 2, 3) for qx in (1, 2, 3)]
    tiles = [pixels[y : y + tile, x : x + tile] for y, x in dict.fromkeys(spots)]
    return next((t for t in tiles if t.mean() <= MOST_MEAN and t.std(ddof=1) >= LEAST_DEVIATION), tiles[0])


def _filter3(pixels: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Edges repeated; over the last two axes."""
    p = np.pad(pixels, [(0, 0)] * (pixels.ndim - 2) + [(1, 1)] * 2, mode="edge")
    h, w = pixels.shape[-2:]
    return sum(kernel[i, j] * p[..., i : i + h, j : j + w] for i in range(3) for j in range(3))


def sharpness(pixels: np.ndarray, tile: int = 512) -> float:
    """F-16: deviation of the Laplacian over a content tile, after a slight blur."""
    side = np.exp(-1 / (2 * BLUR**2))
    line = np.array([side, 1, side]) / (1 + 2 * side)
    blurred = _filter3(content_crop(pixels.astype(np.float64), tile), np.outer(line, line))
    return float(abs(_filter3(blurred, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])).std(ddof=1)))


def sharpnesses(stack: np.ndarray, tile: int = 512) -> list[float]:
    """F-16 of a stack of images: images larger than a tile give way to their content tile first."""
    crops = stack if max(stack.shape[1:]) <= tile else np.stack([content_crop(x, tile) for x in stack])
    side = np.exp(-1 / (2 * BLUR**2))
    line = np.array([side, 1, side]) / (1 + 2 * side)
    sharp = _filter3(_filter3(crops, np.outer(line, line)), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]]))
    return np.abs(sharp.reshape(len(crops), -1).std(1, ddof=1)).tolist()


@F.pandas_udf(T.DoubleType())
def sharpness_udf(pixels: pd.Series) -> pd.Series:
    return pd.Series(by_size(pixels, sharpnesses), dtype="float64")
