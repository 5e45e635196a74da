"""Pixel operators over image rows (height, width, data: grey bytes), numpy inside Arrow batches."""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema


def grey(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width)


# Bytes of pictures that a task keeps with what was said of them.
KEPT = 16 << 20


def remembered(fn: Callable[[np.ndarray], object], most: int = KEPT):
    """fn by (height, width, bytes): a picture equal to one of the last ones, byte for byte, has its answer again."""
    seen: OrderedDict[tuple[int, int, bytes], object] = OrderedDict()
    held = 0

    def of(height: int, width: int, data: bytes):
        nonlocal held
        key = (height, width, bytes(data))
        if key in seen:
            seen.move_to_end(key)
            return seen[key]
        seen[key] = out = fn(grey(*key))
        held += len(key[2])
        while held > most:
            held -= len(seen.popitem(last=False)[0][2])
        return out

    return of


def over_images(fn: Callable[[np.ndarray], object], kind: str):
    """A column function of (height, width, data) from a function of one image."""

    def batch(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
        of = remembered(fn)
        return pd.Series([None if x is None else of(a, b, x) for a, b, x in zip(h, w, d, strict=True)], dtype=object)

    batch.__annotations__ = {"h": pd.Series, "w": pd.Series, "d": pd.Series, "return": pd.Series}
    return lambda height, width, data: F.pandas_udf(batch, kind)(height, width, data)


def split_column(img: np.ndarray) -> int | None:
    """Where a spread is cut: the least inked smoothed column of its middle, nearest the centre; null for single pages."""
    h, w = img.shape
    if not (1.22 <= w / max(1, h) <= 2.2 and h >= 300):
        return None
    ink = (img[h // 10 : h - h // 10] < 200).mean(0)
    smooth = np.convolve(ink, np.full(15, 1 / 15), "same")
    lo, hi = int(0.38 * w), int(0.62 * w)
    band = smooth[lo:hi]
    near = np.flatnonzero(band <= band.min() + 0.005) + lo
    return int(near[np.abs(near - w / 2).argmin()])


def looked_at(keys: DataFrame, picture: Callable[[object], np.ndarray], fn: Callable[[np.ndarray], tuple], kind: str) -> DataFrame:
    """The one column of keys with those of kind (DDL): what fn says of each key's picture.

    Pictures are made where they are looked at, one at a time, and never leave their worker.
    """
    kind_of = to_arrow_schema(S.StructType([keys.schema[0], *S._parse_datatype_string(kind)]))

    def run(batches):
        of = remembered(fn)
        for b in batches:
            for at in range(0, len(b), 1024):
                some = b.column(0).slice(at, 1024)
                said = zip(*(of(*img.shape, img.tobytes()) for img in map(picture, some.to_pylist())), strict=True)
                yield pa.RecordBatch.from_arrays([some, *(pa.array(x, f.type) for x, f in zip(said, list(kind_of)[1:], strict=True))], schema=kind_of)

    return keys.mapInArrow(run, f"{keys.columns[0]} {keys.dtypes[0][1]}, {kind}")


def percentile(img: np.ndarray, q: float) -> float:
    """np.percentile of grey bytes, by their counts."""
    upto = np.bincount(img.ravel(), minlength=256).cumsum()
    place = (img.size - 1) * (q / 100)
    low, share = int(place), place - int(place)
    a, b = (int(np.searchsorted(upto, k, "right")) for k in (low, min(low + 1, img.size - 1)))
    return b - (b - a) * (1 - share) if share >= 0.5 else a + (b - a) * share


@functools.lru_cache(maxsize=8)
def _rays(size: int, reach: float, steps: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(angles, greatest x frequency, cells of each angle's ray in a spectrum of x frequencies from 0 on).

    A cell of negative x is read at the opposite one, which is as strong.
    """
    angles = np.linspace(-reach, reach, steps)
    radius = np.arange(size // 16, size // 2 - 1)
    rad = np.deg2rad(angles)[:, None]
    x = np.rint(size / 2 - radius * np.sin(rad)).astype(int) - size // 2
    y = np.rint(size / 2 + radius * np.cos(rad)).astype(int) - size // 2
    most = int(np.abs(x).max(initial=0))
    return angles, most, np.where(x < 0, -y, y) % size * (most + 1) + np.abs(x)


def skew(img: np.ndarray, reach: float = 15.0, steps: int = 600) -> float:
    """Angle of the text lines: the direction in which the spectrum of the ink is strongest; 0 at the edge of the range.

    Of the spectrum only the columns that a ray meets are made.
    """
    ink = (img < percentile(img, 85)).astype(np.float32)
    size = 1 << int(np.ceil(np.log2(max(ink.shape))))
    angles, most, cells = _rays(size, reach, steps)
    rows = np.fft.rfft(ink - ink.mean(), size, axis=1)[:, : most + 1]
    power = np.abs(np.fft.fft(rows, size, axis=0))
    strength = power.take(cells).sum(1)
    best = float(angles[strength.argmax()])
    return 0.0 if abs(best) >= reach else best


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre, bilinear, white outside; as it is below 0.05 degrees."""
    if abs(degrees) < 0.05:
        return img
    h, w = img.shape
    a = np.deg2rad(degrees)
    cx, cy = (w - 1) / 2, (h - 1) / 2
    x, y = np.arange(w, dtype=np.float32) - cx, (np.arange(h, dtype=np.float32) - cy)[:, None]
    padded = np.pad(img, 1, constant_values=255)  # what lies outside is read in this rim
    out = np.empty((h, w), np.uint8)
    step = max(1, (1 << 13) // w)  # rows at a time, so that what is reckoned on stays small
    for top in range(0, h, step):
        sx = np.cos(a) * x - np.sin(a) * y[top : top + step] + cx
        sy = np.sin(a) * x + np.cos(a) * y[top : top + step] + cy
        x0, y0 = np.floor(sx), np.floor(sy)
        fx, fy = sx - x0, sy - y0
        left, right = (np.clip(x0 + k, 0, w + 1).astype(np.intp) for k in (1, 2))
        upper, lower = (np.clip(y0 + k, 0, h + 1).astype(np.intp) * (w + 2) for k in (1, 2))
        at = (padded.take(upper + left) * (1 - fx) + padded.take(upper + right) * fx) * (1 - fy)
        at += (padded.take(lower + left) * (1 - fx) + padded.take(lower + right) * fx) * fy
        out[top : top + step] = np.clip(np.rint(at), 0, 255)
    return out


def spacing(img: np.ndarray) -> float:
    """Staff spacing: median distance of row-ink peaks in the centre strip; a share of the height where there are few."""
    h, w = img.shape
    rows = (img[:, w // 4 : w - w // 4] < 128).mean(1)
    peak = np.flatnonzero((rows[1:-1] > rows[:-2]) & (rows[1:-1] >= rows[2:]) & (rows[1:-1] > 0.3)) + 1
    kept: list[int] = []
    for p in sorted(peak, key=lambda p: (-rows[p], p)):
        if all(abs(p - k) >= 4 for k in kept):
            kept.append(int(p))
    gaps = np.diff(sorted(kept))
    gaps = gaps[(gaps >= 4) & (gaps <= 40)]
    return float(np.median(gaps)) if len(gaps) >= 2 else h / 4.0


def divide_background(img: np.ndarray, half: int = 8) -> np.ndarray:
    """Each pixel over the mean of its surroundings, as 0..255."""
    k, sums = 2 * half + 1, np.pad(img, half, mode="edge").astype(np.int64)
    for axis in (0, 1):  # sums of k in a row; whole numbers, so no order of adding changes them
        sums = np.pad(sums.cumsum(axis), [(1, 0), (0, 0)] if axis == 0 else [(0, 0), (1, 0)])
        sums = sums[k:] - sums[:-k] if axis == 0 else sums[:, k:] - sums[:, :-k]
    out = sums / k**2
    out += 1e-5
    np.divide(img, out, out=out)
    out *= 255
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def robust_line(x: np.ndarray, y: np.ndarray, delta: float = 1.0, rounds: int = 25) -> tuple[float, float]:
    """Slope and intercept by Huber's loss, iteratively reweighted."""
    a = np.stack([x, np.ones_like(x)], 1).astype(float)
    w = np.ones(len(x))
    sol = np.zeros(2)
    for _ in range(rounds):
        sol = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        r = np.abs(y - a @ sol)
        w = np.where(r <= delta, 1.0, delta / np.maximum(r, 1e-12))
    return float(sol[0]), float(sol[1])


split_column_of: Callable[[Column, Column, Column], Column] = over_images(split_column, "int")
skew_of = over_images(skew, "double")
spacing_of = over_images(spacing, "double")
divided_of = over_images(lambda i: divide_background(i).tobytes(), "binary")
deskewed_of = over_images(lambda i: rotate(i, skew(i)).tobytes(), "binary")
