"""Box arithmetic as column expressions; a box is four columns with a prefix: x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(p: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))


def _inter(a, b):
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def area(a) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a, b) -> Column:
    i = _inter(a, b)
    return F.when(i > 0, i / (area(a) + area(b) - i)).otherwise(0.0)


def contained(small, big) -> Column:
    """Share of the first box that lies in the second."""
    return _inter(small, big) / F.greatest(F.lit(1), area(small))


def vertical_overlap(a, b) -> Column:
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when(h > 0, h / F.greatest(F.lit(1), F.least(a[3] - a[1], b[3] - b[1]))).otherwise(0.0)


def horizontal_overlap_or_gap(a, b) -> Column:
    """Overlap if positive, else the gap with a minus."""
    o = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    return F.when(o > 0, o).when(a[2] <= b[0], -(b[0] - a[2])).otherwise(-(a[0] - b[2]))


def union(a, b) -> list[Column]:
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]


def block_class(staves: Column, height: Column, spacing: Column, now: Column) -> Column:
    """Class of a merged block by the staves in it, or by its height."""
    return F.when((staves >= 3) | (height >= F.floor(26 * spacing)), "system").when((staves == 2) | (height >= F.floor(11 * spacing)), "grand_staff").when(staves == 1, "staff").otherwise(now)
