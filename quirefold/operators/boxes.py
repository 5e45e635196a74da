"""Joins and greedy resolution of detected boxes, by page.

Pair joins are equi-joins on (page, band): a box is put into every horizontal band of
``BAND`` pixels that it touches, and a pair counts in its first common band only, so pages
with very many boxes are dealt over bands as well.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import boxes as B

BAND = 64


def banded(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("band", F.explode(F.sequence(F.floor(F.col("y1") / BAND), F.floor((F.greatest("y2", F.col("y1") + 1) - 1) / BAND))))


def pairs(boxes: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """All pairs of a page whose vertical extents meet, columns with a_ and b_; of one table, each pair once (a.id < b.id)."""
    one = others is None
    a = banded(boxes).select("page", "band", *(F.col(c).alias(f"a_{c}") for c in boxes.columns if c != "page"))
    right = boxes if one else others
    b = banded(right).select("page", "band", *(F.col(c).alias(f"b_{c}") for c in right.columns if c != "page"))
    joined = a.join(b, ["page", "band"]).where((F.least("a_y2", "b_y2") > F.greatest("a_y1", "b_y1")) & (F.col("band") == F.floor(F.greatest("a_y1", "b_y1") / BAND)))
    return (joined.where("a_id < b_id") if one else joined).drop("band")


def uncovered(staves: DataFrame, blocks: DataFrame, least_iou: float = 0.30, least_share: float = 0.5) -> DataFrame:
    """Staves that no block covers."""
    p = pairs(staves, blocks)
    a, b = B.box("a_"), B.box("b_")
    hit = p.where((B.iou(a, b) > least_iou) | (B.contained(a, b) >= least_share)).select("page", F.col("a_id").alias("id")).distinct()
    return staves.join(hit, ["page", "id"], "left_anti")


def not_contained(boxes: DataFrame, share: float = 0.6) -> DataFrame:
    """Boxes that lie in no other by that share (two that contain each other both go)."""
    p = pairs(boxes)
    a, b = B.box("a_"), B.box("b_")
    inner = p.where(B.contained(a, b) >= share).select("page", F.col("a_id").alias("id")).unionByName(p.where(B.contained(b, a) >= share).select("page", F.col("b_id").alias("id")))
    return boxes.join(inner.distinct(), ["page", "id"], "left_anti")


def staves_inside(blocks: DataFrame, staves: DataFrame, spacing: float = 8.5) -> DataFrame:
    """(page, id, staves): staves whose middle lies in a block (one spacing of slack, two to the sides)."""
    mid = staves.select("page", ((F.col("y1") + F.col("y2")) / 2).alias("my"), ((F.col("x1") + F.col("x2")) / 2).alias("mx")).withColumn("band", F.floor(F.col("my") / BAND))
    wide = blocks.withColumn("band", F.explode(F.sequence(F.floor((F.col("y1") - spacing) / BAND), F.floor((F.col("y2") + spacing) / BAND))))
    inside = F.col("my").between(F.col("y1") - spacing, F.col("y2") + spacing) & F.col("mx").between(F.col("x1") - 2 * spacing, F.col("x2") + 2 * spacing)
    found = wide.join(mid, ["page", "band"]).where(inside).groupBy("page", "id").agg(F.count("*").alias("staves"))
    return blocks.select("page", "id").join(found, ["page", "id"], "left").na.fill(0, ["staves"])


def by_page(boxes: DataFrame, fn: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Apply fn to the boxes of each page (few by nature), streaming over partitions dealt and sorted by page."""
    kind = to_arrow_schema(boxes.schema)

    names = boxes.columns

    def run(batches):
        def rows():
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield dict(zip(names, r, strict=True))

        out = []
        for _, page in groupby(rows(), key=lambda r: r["page"]):
            out += fn(list(page))
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return boxes.repartition("page").sortWithinPartitions("page").mapInArrow(run, boxes.schema)


def suppressed(most: float = 0.5) -> Callable[[list[dict]], list[dict]]:
    """Greedy suppression of a page: boxes in order of confidence stay if they overlap none that stayed by over `most`."""

    def page(rows):
        kept = []
        for r in sorted(rows, key=lambda r: (-r["conf"], r["id"])):
            if all(_iou(r, k) <= most for k in kept):
                kept.append(r)
        return kept

    return page


def suppress(boxes: DataFrame, most: float = 0.5) -> DataFrame:
    return by_page(boxes, suppressed(most))


def _iou(a: dict, b: dict) -> float:
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h)


def healed(overlap: float = 0.55, least_gap: int = 40) -> Callable[[list[dict]], list[dict]]:
    """Boxes of one class on one line, close side by side, become one; a grown box goes on growing."""

    def page(rows):
        most = max(least_gap, int(0.04 * max(r["x2"] for r in rows)))
        rest, out = sorted(rows, key=lambda r: (-r["conf"], r["id"])), []
        while rest:
            cur = rest.pop(0)
            while mate := next((r for r in rest if _in_line(cur, r, overlap, most)), None):
                rest.remove(mate)
                cur |= {"x1": min(cur["x1"], mate["x1"]), "y1": min(cur["y1"], mate["y1"]), "x2": max(cur["x2"], mate["x2"]), "y2": max(cur["y2"], mate["y2"]), "conf": max(cur["conf"], mate["conf"])}
            out.append(cur)
        return out

    return page


def heal(boxes: DataFrame, overlap: float = 0.55, least_gap: int = 40) -> DataFrame:
    return by_page(boxes, healed(overlap, least_gap))


def _in_line(a: dict, b: dict, overlap: float, most: int) -> bool:
    if a["cls"] != b["cls"] or max(a["x1"], b["x1"]) - min(a["x2"], b["x2"]) > most:
        return False
    ha, hb = a["y2"] - a["y1"], b["y2"] - b["y1"]
    shared = min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    level = abs((a["y1"] + a["y2"]) - (b["y1"] + b["y2"])) / 2
    tall = max(ha, hb)
    return shared / max(1, min(ha, hb)) >= overlap and abs(ha - hb) <= max(10, 0.3 * tall) and level <= max(8, 0.2 * tall)


def padded(spacing: float = 8.5) -> Callable[[list[dict]], list[dict]]:
    """Vertical padding of each block, held off the blocks above (as padded) and below that share its columns."""
    want = int(min(16, max(6, 0.8 * spacing)))

    def page(rows):
        rows, done = sorted(rows, key=lambda r: (r["y1"], r["id"])), []
        for i, r in enumerate(rows):
            share = lambda o, r=r: min(r["x2"], o["x2"]) > max(r["x1"], o["x1"])
            top = max([0, r["y1"] - want, *(o["y2"] for o in done if share(o) and o["y2"] <= r["y1"])])
            low = min([r["y2"] + want, *(o["y1"] for o in rows[i + 1 :] if share(o) and o["y1"] >= r["y2"])])
            done.append({**r, "y1": top, "y2": low})
        return done

    return page


def pad(boxes: DataFrame, spacing: float = 8.5) -> DataFrame:
    return by_page(boxes, padded(spacing))


def resolve(boxes: DataFrame) -> DataFrame:
    """Suppression, healing and padding of a page's boxes, one after the other, in one pass over the pages."""
    steps = (suppressed(), healed(), padded())

    def page(rows):
        for step in steps:
            rows = step(rows)
        return rows

    return by_page(boxes, page)


def split_wide(boxes: DataFrame, gutters: DataFrame, spacing: float = 8.5) -> DataFrame:
    """Boxes of 28 spacings and wider are cut at a gutter of their page in their middle half.

    gutters: (page, gx1, gx2); of several, the widest, then the first.
    """
    wide = F.col("x2") - F.col("x1")
    inside = (wide >= int(28 * spacing)) & (F.col("gx2") - F.col("gx1") >= int(3 * spacing)) & (F.col("gx1") >= F.col("x1") + wide / 4) & (F.col("gx2") <= F.col("x2") - wide / 4)
    best = boxes.join(gutters, "page").where(inside).groupBy("page", "id").agg(F.max_by(F.struct("gx1", "gx2"), F.struct(F.col("gx2") - F.col("gx1"), -F.col("gx1"))).alias("g"))
    joined = boxes.join(best, ["page", "id"], "left")
    ends = F.when(F.col("g").isNull(), F.array(F.struct(F.col("x1").alias("a"), F.col("x2").alias("b")))).otherwise(F.array(F.struct(F.col("x1").alias("a"), F.col("g.gx1").alias("b")), F.struct(F.col("g.gx2").alias("a"), F.col("x2").alias("b"))))
    return joined.withColumn("e", F.explode(ends)).withColumns({"x1": F.col("e.a"), "x2": F.col("e.b")}).select(*boxes.columns)


