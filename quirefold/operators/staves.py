"""Staff crops: line skeletons, curl of the paper, normalised crops, and what joins two staves. One image at a time, numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .pixels import divide_background, grey, over_images, percentile, rotate, skew

# What counts as ink, lines and bends.
INK, JOIN_INK = 35, 28
BEND, HINGE, GAIN, MOST = 1.5, (0.15, 0.35, 9), 0.65, 20.0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, first row, row behind the last) of every vertical run of ink, by column."""
    edge = np.diff(np.pad(mask.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    col, first = np.nonzero(edge == 1)
    return col, first, np.nonzero(edge == -1)[1]


def _mode(lengths: np.ndarray, low: int, high: int, default: int) -> int:
    return int(np.clip(np.bincount(lengths)[1:].argmax() + 1 if len(lengths) else default, low, high))


def close_rows(mask: np.ndarray, width: int) -> np.ndarray:
    """Gaps of less than width between ink of one row are filled."""
    out = mask.copy()
    row, first, end = runs(mask.T)
    near = (row[1:] == row[:-1]) & (first[1:] - end[:-1] < width)
    for r, a, b in zip(row[1:][near], end[:-1][near], first[1:][near], strict=True):
        out[r, a:b] = True
    return out


def _five(rows: np.ndarray, space: int, height: int) -> list[int]:
    if len(rows) < 5:
        return [round(height / 2 + (k - 2) * space) for k in range(5)]
    fives = np.lib.stride_tricks.sliding_window_view(rows, 5)
    gaps = np.diff(fives, axis=1)
    off = np.where(np.ptp(gaps, axis=1) <= 3, np.abs(gaps - space).mean(1), np.inf)
    return fives[off.argmin()].tolist()  # none even: the first five


def skeleton(img: np.ndarray, grand: bool = False) -> tuple[np.ndarray, int, int, list[int]]:
    """(mask of the staff lines, their thickness, their spacing, rows of 5 or 10 lines).

    Vertical runs of more than 2.2 thicknesses (heads, stems, beams) go; short gaps along the lines close.
    Rows are peaks of a strip at the centre; without five of them, five evenly about the middle.
    """
    h, w = img.shape
    ink = img < percentile(img, 90) - INK
    col, first, end = runs(ink[:, np.linspace(int(w * 0.15), int(w * 0.85), 30, dtype=int)])
    thick = _mode(end - first, 1, 4, 2)
    space = _mode((first[1:] - end[:-1])[col[1:] == col[:-1]], 5, 35, h // 4)
    col, first, end = runs(ink)
    fine = end - first <= round(2.2 * thick)
    step = np.zeros((w, h + 1), np.int32)
    np.add.at(step, (col[fine], first[fine]), 1)
    np.add.at(step, (col[fine], end[fine]), -1)
    lines = close_rows(step.cumsum(1)[:, :h].T > 0, max(5, int(1.4 * space)))
    strip = lines[:, max(0, w // 2 - 25) : w // 2 + 25]
    ray = strip.sum(1)
    peaks = np.flatnonzero((ray[1:-1] > ray[:-2]) & (ray[1:-1] >= ray[2:]) & (ray[1:-1] > 0.15 * strip.shape[1])) + 1
    kept: list[int] = []
    for y in peaks[np.argsort(-ray[peaks], kind="stable")].tolist():
        if all(abs(y - k) >= max(3, int(0.55 * space)) for k in kept):
            kept.append(y)
    rows = np.sort(np.array(kept, int))
    upper, lower = rows[rows < 0.55 * h], rows[rows >= 0.45 * h]
    if grand and len(rows) >= 10 and min(len(upper), len(lower)) >= 5:
        return lines, thick, space, [*upper[:5].tolist(), *lower[-5:].tolist()]
    return lines, thick, space, _five(rows, space, h)


def displacement(lines: np.ndarray, rows: list[int], space: int) -> tuple[np.ndarray, int, int] | None:
    """(shift of the lines in each column, first and last column with lines), all lines followed as one sheet from the centre outward.

    None where fewer than 50 columns have lines. A column without ink keeps the shift before it.
    """
    h, w = lines.shape
    at, band = np.array(rows), max(2, round(space * 0.35))
    above = np.concatenate([np.zeros((1, w), int), lines.cumsum(0)])
    there = above[np.clip(at + band + 1, 0, h)] > above[np.clip(at - band, 0, h)]
    cols = np.flatnonzero(there.sum(0) >= max(2, len(rows) // 3))
    if len(cols) < 50:
        return None
    x0, x1 = int(cols[0]), int(cols[-1])
    dy, tries = np.zeros(w), np.linspace(-1.5, 1.5, 7)
    columns = np.ascontiguousarray(lines.T).tobytes()
    for path in (range(w // 2, x1 + 1), range(w // 2, x0 - 1, -1)):
        now, known = 0.0, None
        for x in path:
            if now != known:
                y = np.rint(at + now + tries[:, None]).astype(int)
                known, places = now, [[p for p in row if 0 <= p < h] for row in y.tolist()]
            column = columns[x * h : x * h + h]
            score = [sum([column[p] for p in row]) for row in places]
            if any(score):
                now += 0.25 * tries[score.index(max(score))]
            dy[x] = now
    dy[:x0], dy[x1:] = dy[x0], dy[x1]
    return dy, x0, x1


def _huber(r: np.ndarray) -> float:
    return float(np.where(np.abs(r) < BEND, r**2 / 2, BEND * np.abs(r) - BEND**2 / 2).sum())


def _curl(dist: np.ndarray, dy: np.ndarray, length: float) -> tuple[float, float]:
    """Height and reach of a bend that falls off as (1 - dist / reach) squared; 0 where flat explains it nearly as well."""
    best, height, reach = _huber(dy), 0.0, 0.25 * length
    for r in length * np.linspace(*HINGE):
        t = np.maximum(0, 1 - dist / r) ** 2
        on = t > 0.01
        if len(dy) < 15 or on.sum() < 8:
            continue
        weight = np.ones(on.sum())
        for _ in range(3):
            a = float((weight * t[on] * dy[on]).sum() / max(1e-6, (weight * t[on] ** 2).sum()))
            weight = np.minimum(1, BEND / np.maximum(np.abs(dy[on] - a * t[on]), 1e-4))
        loss = _huber(dy[on] - a * t[on])
        if loss < GAIN * best and abs(a) >= BEND:
            best, height, reach = loss, a, float(r)
    return float(np.clip(height, -MOST, MOST)), reach


def bend(dy: np.ndarray, x0: int, x1: int) -> np.ndarray:
    """The smooth shift of each column: a slope from the middle half and a curl at one gutter, or at both of like height."""
    x, length = np.arange(len(dy)), float(max(10, x1 - x0))
    mid = (x >= x0 + int(length / 4)) & (x <= x0 + int(length * 3 / 4))
    mid = mid if mid.sum() >= 20 else np.ones(len(x), bool)
    slope, base = np.polyfit(x[mid], dy[mid], 1)
    rest, out = dy - (slope * x + base), np.zeros(len(x))
    if abs(slope * length) >= 1:
        out += slope * (x - (x0 + x1) / 2)
    sides = []
    for dist in (x - x0, x1 - x):
        near = (dist >= 0) & (dist <= int(length * 0.35))
        sides.append((*_curl(dist[near].astype(float), rest[near], length), dist))
    heights = [abs(s[0]) for s in sides]
    for (height, reach, dist), other in zip(sides, heights[::-1], strict=True):
        ruled = min(heights) >= BEND and other >= 1.5 * abs(height)
        if abs(height) >= 1.2 and not ruled:
            out += height * np.maximum(0, 1 - np.maximum(0, dist) / max(1, reach)) ** 2
    return out


def shift_columns(img: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Each column read dy lower, by lines between its pixels, white outside."""
    h, w = img.shape
    y = np.arange(h)[:, None] + dy[None, :]
    low = np.floor(y).astype(int)
    padded = np.pad(img.astype(np.float64), ((1, 1), (0, 0)), constant_values=255)
    at = lambda r: padded[np.clip(r + 1, 0, h + 1), np.arange(w)[None, :]]
    return np.clip(np.rint(at(low) * (1 - (y - low)) + at(low + 1) * (y - low)), 0, 255).astype(np.uint8)


def normalise(img: np.ndarray, grand: bool = False, flatten: bool = False) -> tuple[np.ndarray, float, float]:
    """(crop, tilt in degrees, bend in pixels): turned level with room above and below, bends of a pixel or more taken out.

    Crops under 15 x 30 stay as they are; narrower than 120 or lower than 20 they are only turned.
    """
    h, w = img.shape
    if h < 15 or w < 30:
        return img, 0.0, 0.0
    tilt = skew(img)
    out = img
    if abs(tilt) >= 0.1:
        room = int(np.ceil(w * np.sin(np.deg2rad(abs(tilt))) / 2)) + 4
        out = rotate(np.pad(img, ((room, room), (0, 0)), constant_values=255), tilt)
    most = 0.0
    if w >= 120 and out.shape[0] >= 20:
        lines, _, space, rows = skeleton(out, grand)
        if (found := displacement(lines, rows, space)) is not None:
            curve = bend(*found)
            most = float(np.abs(curve).max())
            out, most = (shift_columns(out, curve), most) if most >= 1 else (out, 0.0)
    return divide_background(out, 15) if flatten else out, round(tilt, 1), round(most, 1)


def _otsu(img: np.ndarray) -> int:
    """The level that parts dark from light with the greatest variance between them."""
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    dark, total = n.cumsum(), (n * np.arange(256)).cumsum()
    light = dark[-1] - dark
    with np.errstate(divide="ignore", invalid="ignore"):
        between = dark * light * (total / dark - (total[-1] - total) / light) ** 2
    return int(np.nan_to_num(between, nan=0.0, posinf=0.0).argmax())


def components(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of each 8-connected piece of ink, ends exclusive: runs of columns joined to their neighbours'."""
    col, first, end = runs(mask)
    root = np.arange(len(col))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    start = np.searchsorted(col, np.arange(mask.shape[1] + 1))
    for c in range(1, mask.shape[1]):
        i, j = start[c - 1], start[c]
        while i < start[c] and j < start[c + 1]:
            if first[i] <= end[j] and first[j] <= end[i]:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
            i, j = (i + 1, j) if end[i] < end[j] else (i, j + 1)
    group = np.array([top(i) for i in range(len(col))], int)
    return [(int(col[g].min()), int(first[g].min()), int(col[g].max()) + 1, int(end[g].max())) for g in (group == r for r in np.unique(group))]


def connector(img: np.ndarray, upper: tuple[int, int], lower: tuple[int, int], space: float) -> int | None:
    """The column where a brace, bracket or barline joins two staves at their left, or None.

    upper: (left, bottom), lower: (left, top). A piece of ink over the gap counts, or a corridor of 1.8
    spaces in which three quarters of the gap's rows have ink. Staves that overlap are joined.
    """
    left, s = min(upper[0], lower[0]), max(5.0, space)
    gap = lower[1] - upper[1]
    if gap < 0:
        return left
    x0, x1 = max(0, int(left - 6.5 * s)), min(img.shape[1], int(left + 2 * s))
    y0, y1 = max(0, int(upper[1] - 1.5 * s)), min(img.shape[0], int(lower[1] + 1.5 * s))
    strip = img[y0 : max(y0, y1), x0 : max(x0, x1)]
    if strip.size == 0:
        return None
    if gap == 0:
        return left
    soft = np.pad(strip.astype(float), 1, mode="reflect" if min(strip.shape) > 1 else "edge")
    soft = soft[:-2] / 4 + soft[1:-1] / 2 + soft[2:] / 4
    soft = np.rint(soft[:, :-2] / 4 + soft[:, 1:-1] / 2 + soft[:, 2:] / 4).astype(np.uint8)
    ink = (strip < percentile(strip, 85) - JOIN_INK) | (soft <= _otsu(soft))
    a, b, slack = upper[1] - y0, lower[1] - y0, int(s / 2)
    for cl, ct, cr, cb in components(ink):
        tall, wide = cb - ct, cr - cl
        if ct <= a + slack and cb >= b - slack and tall >= 0.8 * gap and (tall >= 1.2 * wide or wide <= int(3.5 * s)):
            return x0 + cl
    grown = ink.copy()
    grown[1:] |= ink[:-1]
    grown[:-1] |= ink[1:]
    span = max(5, int(1.8 * s))
    count = np.pad(grown[a:b].cumsum(1), ((0, 0), (1, 0)))
    if count.shape[1] <= span or count.shape[0] == 0:
        return None
    share = (count[:, span:] > count[:, :-span]).mean(0)
    return x0 + int(share.argmax()) if share.max() >= 0.75 else None


def to_png(img: np.ndarray) -> bytes:
    """A grey image as PNG bytes."""
    piece = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.pad(img, ((0, 0), (1, 0))).tobytes()  # every row by filter 0
    return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0, 0, 0, 0)) + piece(b"IDAT", zlib.compress(rows, 6)) + piece(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The grey image of PNG bytes as to_png writes them; ValueError for any other kind."""
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    body, at = b"", 8
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        body += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1)
    if (depth, colour) != (8, 0) or rows[:, 0].any():
        raise ValueError("not a grey image with plain rows")
    return rows[:, 1:]


def records_of(fn, kind: str):
    """A column function of (height, width, data) to structs, from a function of one image to a dict; null data gives null fields."""
    names = [part.split()[0] for part in kind.split(", ")]

    def batch(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{} if x is None else fn(grey(a, b, x)) for a, b, x in zip(h, w, d, strict=True)], columns=names, dtype=object)

    batch.__annotations__ = {"h": pd.Series, "w": pd.Series, "d": pd.Series, "return": pd.DataFrame}
    return lambda height, width, data: F.pandas_udf(batch, kind)(height, width, data)


def _seen(img: np.ndarray) -> dict:
    mask, thick, space, rows = skeleton(img)
    return {"thick": thick, "space": space, "lines": rows, "ink": int(mask.sum())}


def _levelled(img: np.ndarray) -> dict:
    out, tilt, most = normalise(img)
    return {"height": out.shape[0], "data": out.tobytes(), "tilt": tilt, "bend": most}


skeleton_of = records_of(_seen, "thick int, space int, lines array<int>, ink long")
normalised_of = records_of(_levelled, "height int, data binary, tilt double, bend double")
png_of = over_images(to_png, "binary")
