"""Box queries. Line items are boxes: an order is a page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import boxes as O
from .registry import query, table

_B = """b AS (SELECT DISTINCT l_orderkey AS page, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS id, l_partkey % 500 AS x1, l_suppkey % 300 AS y1,
l_partkey % 500 + 50 + 20 * l_linenumber AS x2, l_suppkey % 300 + 40 + 10 * l_linenumber AS y2, l_discount AS conf, CASE l_linenumber % 3 WHEN 0 THEN 'staff' WHEN 1 THEN 'grand_staff' ELSE 'system' END AS cls FROM lineitem)"""
_P = f"""{_B}, i AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM b),
p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, a.w * a.h AS aa, b.w * b.h AS ba FROM i a JOIN i b ON a.page = b.page AND a.id <> b.id)"""


def boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page", "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS id", "l_partkey % 500 AS x1", "l_suppkey % 300 AS y1", "l_partkey % 500 + 50 + 20 * l_linenumber AS x2", "l_suppkey % 300 + 40 + 10 * l_linenumber AS y2",
        "l_discount AS conf", "CASE l_linenumber % 3 WHEN 0 THEN 'staff' WHEN 1 THEN 'grand_staff' ELSE 'system' END AS cls",
    ).distinct()


@query("joi_12", f"WITH {_P} SELECT page, a_id, b_id, round(inter / (aa + ba - inter)::DOUBLE, 9)::DOUBLE AS iou FROM p WHERE a_id < b_id AND inter > 0 AND inter / (aa + ba - inter)::DOUBLE > 0.3")
def joi_12(spark, sf_dir):
    """Pairs of boxes of a page that overlap by over 0.3."""
    p = O.pairs(boxes(spark, sf_dir)).withColumn("iou", B.iou(B.box("a_"), B.box("b_")))
    return p.where("iou > 0.3").select("page", "a_id", "b_id", F.round("iou", 9).alias("iou"))


@query("joi_15", f"WITH {_P} SELECT page, id FROM b ANTI JOIN (SELECT page, a_id AS id FROM p WHERE inter / greatest(1, aa)::DOUBLE >= 0.6) USING (page, id)")
def joi_15(spark, sf_dir):
    """Boxes that lie in no other."""
    return O.not_contained(boxes(spark, sf_dir)).select("page", "id")


@query("joi_13", f"WITH {_P}, k AS (SELECT page, id FROM b WHERE cls <> 'staff') SELECT page, id FROM b WHERE cls = 'staff' AND (page, id) NOT IN (SELECT page, a_id FROM p JOIN k ON k.page = p.page AND k.id = p.b_id WHERE inter / (aa + ba - inter)::DOUBLE > 0.3 OR inter / greatest(1, aa)::DOUBLE >= 0.5)".replace("SELECT page, a_id FROM p JOIN", "SELECT p.page, a_id FROM p JOIN"))
def joi_13(spark, sf_dir):
    """Staves that no block covers."""
    b = boxes(spark, sf_dir)
    return O.uncovered(b.where("cls = 'staff'"), b.where("cls <> 'staff'")).select("page", "id")


@query("joi_14", f"WITH {_B} SELECT k.page, k.id, count(s.id)::BIGINT AS staves FROM b k LEFT JOIN b s ON s.page = k.page AND s.cls = 'staff' AND (s.y1 + s.y2) / 2::DOUBLE BETWEEN k.y1 - 8.5 AND k.y2 + 8.5 AND (s.x1 + s.x2) / 2::DOUBLE BETWEEN k.x1 - 17 AND k.x2 + 17 WHERE k.cls <> 'staff' GROUP BY ALL")
def joi_14(spark, sf_dir):
    """Staves whose middle lies in a block."""
    b = boxes(spark, sf_dir)
    return O.staves_inside(b.where("cls <> 'staff'"), b.where("cls = 'staff'"))


@query("prj_03", f"WITH {_P} SELECT page, a_id, b_id, round(CASE WHEN least(ay2, by2) > greatest(ay1, by1) THEN (least(ay2, by2) - greatest(ay1, by1)) / least(ay2 - ay1, by2 - by1)::DOUBLE ELSE 0 END, 9)::DOUBLE AS v, CASE WHEN least(ax2, bx2) > greatest(ax1, bx1) THEN least(ax2, bx2) - greatest(ax1, bx1) WHEN ax2 <= bx1 THEN ax2 - bx1 ELSE bx2 - ax1 END::BIGINT AS h, least(ax1, bx1)::BIGINT AS ux1, greatest(ay2, by2)::BIGINT AS uy2 FROM p WHERE a_id < b_id AND least(ay2, by2) > greatest(ay1, by1)")
def prj_03(spark, sf_dir):
    """Box arithmetic over the pairs of a page that meet vertically."""
    a, b = B.box("a_"), B.box("b_")
    u = B.union(a, b)
    return O.pairs(boxes(spark, sf_dir)).select("page", "a_id", "b_id", F.round(B.vertical_overlap(a, b), 9).alias("v"), B.horizontal_overlap_or_gap(a, b).cast("long").alias("h"), u[0].cast("long").alias("ux1"), u[3].cast("long").alias("uy2"))


@query("prj_04", f"WITH {_B} SELECT page, id, greatest(0, x1)::BIGINT AS cx1, greatest(0, y1)::BIGINT AS cy1, least(520, x2)::BIGINT AS cx2, least(330, y2)::BIGINT AS cy2 FROM b")
def prj_04(spark, sf_dir):
    """Crop bounds held in the page."""
    return boxes(spark, sf_dir).select("page", "id", F.greatest(F.lit(0), "x1").cast("long").alias("cx1"), F.greatest(F.lit(0), "y1").cast("long").alias("cy1"), F.least(F.lit(520), "x2").cast("long").alias("cx2"), F.least(F.lit(330), "y2").cast("long").alias("cy2"))


@query("prj_05", f"WITH {_B}, n AS (SELECT page, id, cls, y2 - y1 AS h, (id % 4) AS s FROM b) SELECT page, id, CASE WHEN s >= 3 OR h >= 221 THEN 'system' WHEN s = 2 OR h >= 93 THEN 'grand_staff' WHEN s = 1 THEN 'staff' ELSE cls END AS cls FROM n")
def prj_05(spark, sf_dir):
    """Class of a block by its staves and height."""
    return boxes(spark, sf_dir).select("page", "id", B.block_class(F.col("id") % 4, F.col("y2") - F.col("y1"), F.lit(8.5), F.col("cls")).alias("cls"))


@query("joi_16", f"WITH {_B}, o AS (SELECT page, id, lead(id) OVER w AS next_id, lead(y1) OVER w - y2 AS gap FROM b WINDOW w AS (PARTITION BY page ORDER BY y1, id)) SELECT page, id, next_id, gap::BIGINT AS gap FROM o WHERE next_id IS NOT NULL")
def joi_16(spark, sf_dir):
    """Neighbouring rows."""
    w = Window.partitionBy("page").orderBy("y1", "id")
    o = boxes(spark, sf_dir).select("page", "id", F.lead("id").over(w).alias("next_id"), (F.lead("y1").over(w) - F.col("y2")).cast("long").alias("gap"))
    return o.where("next_id is not null")


@query("flt_13", f"WITH {_B}, o AS (SELECT page, id, y2 - y1 >= 102 AS monster, coalesce(cls = 'staff' AND lead(cls) OVER w = 'staff' AND lead(y1) OVER w - y2 BETWEEN 0 AND 72.25, false) AS split FROM b WINDOW w AS (PARTITION BY page ORDER BY y1, id)) SELECT page, count_if(monster)::BIGINT AS monsters, count_if(split)::BIGINT AS splits FROM o GROUP BY page")
def flt_13(spark, sf_dir):
    """Layout anomalies of a page."""
    w = Window.partitionBy("page").orderBy("y1", "id")
    gap = F.lead("y1").over(w) - F.col("y2")
    split = (F.col("cls") == "staff") & (F.lead("cls").over(w) == "staff") & gap.between(0, 72.25)
    o = boxes(spark, sf_dir).select("page", (F.col("y2") - F.col("y1") >= 102).alias("monster"), F.coalesce(split, F.lit(False)).alias("split"))
    return o.groupBy("page").agg(F.count_if("monster").alias("monsters"), F.count_if("split").alias("splits"))


@query("flt_14", f"WITH {_P}, q AS (SELECT *, by1 - ay2 AS gap, (a_id + b_id) % 3 = 0 AS conn, inter / (aa + ba - inter)::DOUBLE AS iou, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) / greatest(1, greatest(ax2, bx2) - least(ax1, bx1))::DOUBLE AS hiou FROM p WHERE a_id < b_id) SELECT page, count_if((conn AND gap BETWEEN 0 AND 102) OR (gap BETWEEN 0 AND 55 AND hiou >= 0.5))::BIGINT AS merges FROM q GROUP BY page")
def flt_14(spark, sf_dir):
    """Pairs of staves that belong together."""
    b = boxes(spark, sf_dir)
    a, c = (b.select("page", *(F.col(x).alias(f"{p}_{x}") for x in ("id", "x1", "y1", "x2", "y2"))) for p in ("a", "b"))
    q = a.join(c, "page").where("a_id < b_id")
    gap = F.col("b_y1") - F.col("a_y2")
    hiou = F.greatest(F.lit(0), F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) / F.greatest(F.lit(1), F.greatest("a_x2", "b_x2") - F.least("a_x1", "b_x1"))
    conn = (F.col("a_id") + F.col("b_id")) % 3 == 0
    return q.groupBy("page").agg(F.count_if((conn & gap.between(0, 102)) | (gap.between(0, 55) & (hiou >= 0.5))).alias("merges"))


@query("flt_07", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN raw IN ('grand_staff', 'system') AND h < 59 THEN 'staff' ELSE raw END AS cls FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'grand_staff' WHEN 'N' THEN 'system' ELSE 'staff' END AS raw, 10 * l_linenumber AS h, l_quantity AS w FROM lineitem) WHERE w >= 10 AND h >= 20")
def flt_07(spark, sf_dir):
    """Classes made plain; low blocks are staves; tiny boxes go."""
    x = table(spark, sf_dir, "lineitem").withColumns({"raw": F.expr("CASE l_returnflag WHEN 'A' THEN 'grand_staff' WHEN 'N' THEN 'system' ELSE 'staff' END"), "h": F.col("l_linenumber") * 10})
    x = x.where("l_quantity >= 10 and h >= 20")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("raw").isin("grand_staff", "system") & (F.col("h") < 59), "staff").otherwise(F.col("raw")).alias("cls"))


@query("agg_05", f"WITH {_B} SELECT page, cls, count(*)::BIGINT AS n, min(y2 - y1)::BIGINT AS low, max(y2 - y1)::BIGINT AS high FROM b GROUP BY ALL")
def agg_05(spark, sf_dir):
    """Classes and heights of a page."""
    h = F.col("y2") - F.col("y1")
    return boxes(spark, sf_dir).groupBy("page", "cls").agg(F.count("*").alias("n"), F.min(h).cast("long").alias("low"), F.max(h).cast("long").alias("high"))


@query("agg_06", f"WITH {_B} SELECT coalesce(cls, '(all)') AS cls, count(*)::BIGINT AS n, count(DISTINCT page)::BIGINT AS pages FROM b GROUP BY ROLLUP (cls)")
def agg_06(spark, sf_dir):
    """Totals of a page range by class and over all."""
    return boxes(spark, sf_dir).rollup("cls").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages")).select(F.coalesce("cls", F.lit("(all)")).alias("cls"), "n", "pages")


@query("srt_02", f"WITH {_B} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY conf DESC, id)::INTEGER AS rank FROM b")
def srt_02(spark, sf_dir):
    """Order of confidence."""
    return boxes(spark, sf_dir).select("page", "id", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("conf"), "id")).alias("rank"))


@query("srt_03", f"WITH {_B} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY y1, id)::INTEGER AS rank FROM b")
def srt_03(spark, sf_dir):
    """Reading order."""
    return boxes(spark, sf_dir).select("page", "id", F.row_number().over(Window.partitionBy("page").orderBy("y1", "id")).alias("rank"))


@query("srt_01", "SELECT p_name, count(*)::BIGINT AS n, min(p_partkey) AS first FROM part GROUP BY p_name ORDER BY p_name")
def srt_01(spark, sf_dir):
    """Order of names."""
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).orderBy("p_name")


@query("set_04", f"WITH {_B} SELECT page, id, cls FROM b WHERE cls <> 'staff' UNION ALL SELECT page, id, 'single' FROM b WHERE cls = 'staff'")
def set_04(spark, sf_dir):
    """Two candidate lists in one."""
    b = boxes(spark, sf_dir)
    return b.where("cls <> 'staff'").select("page", "id", "cls").unionByName(b.where("cls = 'staff'").select("page", "id", F.lit("single").alias("cls")))


@query("mth_04", "SELECT p_partkey, least(1485, greatest(32, (h + 31) // 32 * 32))::INTEGER AS batch_h, least(1280, greatest(1024, (h + 31) // 32 * 32))::INTEGER AS imgsz FROM (SELECT p_partkey, (p_partkey % 1700)::INTEGER AS h FROM part)")
def mth_04(spark, sf_dir):
    """Heights in steps of 32, held in bounds."""
    step = (F.ceil((F.col("p_partkey") % 1700) / 32) * 32).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.lit(1485), F.greatest(F.lit(32), step)).alias("batch_h"), F.least(F.lit(1280), F.greatest(F.lit(1024), step)).alias("imgsz"))


@query("mth_05", "SELECT p_partkey, least(1.0::DOUBLE, 1050 / (p_partkey % 1700 + 1)::DOUBLE, 1485 / (p_size * 40)::DOUBLE)::DOUBLE AS scale FROM part")
def mth_05(spark, sf_dir):
    """Scale that fits a crop into its batch."""
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.lit(1.0), 1050 / (F.col("p_partkey") % 1700 + 1), 1485 / (F.col("p_size") * 40)).alias("scale"))


@query("mth_06", "SELECT p_partkey, trunc(w * s)::BIGINT AS nw, trunc(h * s)::BIGINT AS nh FROM (SELECT *, CASE WHEN greatest(w, h) > 1600 THEN 1600::DOUBLE / greatest(w, h) ELSE 1::DOUBLE END AS s FROM (SELECT p_partkey, p_partkey + 1 AS w, p_size * 60 AS h FROM part))")
def mth_06(spark, sf_dir):
    """Image sizes held under 1600."""
    x = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey + 1 AS w", "p_size * 60 AS h")
    s = F.when(F.greatest("w", "h") > 1600, 1600.0 / F.greatest("w", "h")).otherwise(1.0)
    return x.select("p_partkey", (F.col("w") * s).cast("long").alias("nw"), (F.col("h") * s).cast("long").alias("nh"))


@query("mth_07", "SELECT p_partkey, least(512, greatest(160, trunc(0.35::DOUBLE * p_partkey)::INTEGER))::INTEGER AS bound FROM part")
def mth_07(spark, sf_dir):
    """Token bound by width."""
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.lit(512), F.greatest(F.lit(160), (F.lit(0.35) * F.col("p_partkey")).cast("int"))).alias("bound"))


@query("mth_10", "SELECT p_partkey, trunc(least(16::DOUBLE, greatest(6::DOUBLE, 0.8::DOUBLE * p_size)))::INTEGER AS pad_y, trunc(least(30::DOUBLE, greatest(12::DOUBLE, 1.5::DOUBLE * p_size)))::INTEGER AS pad_x FROM part")
def mth_10(spark, sf_dir):
    """Padding by staff spacing."""
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.lit(16.0), F.greatest(F.lit(6.0), 0.8 * s)).cast("int").alias("pad_y"), F.least(F.lit(30.0), F.greatest(F.lit(12.0), 1.5 * s)).cast("int").alias("pad_x"))


@query("img_17")
def img_17(spark, sf_dir):
    """Greedy suppression, healing and padding of a page's boxes (order decides, so by page in Python, all three in one pass)."""
    return O.resolve(boxes(spark, sf_dir)).select("page", "id", "x1", "y1", "x2", "y2", "cls")


@query("img_12")
def img_12(spark, sf_dir):
    """Healing of boxes on one line."""
    return O.heal(boxes(spark, sf_dir)).groupBy("page").agg(F.count("*").alias("n"))


@query("win_22")
def win_22(spark, sf_dir):
    """Padding that keeps off the neighbours."""
    return O.pad(boxes(spark, sf_dir)).select("page", "id", "y1", "y2")


@query("img_11", f"WITH {_B}, g AS (SELECT DISTINCT page, 200 + page % 7 AS gx1, 230 + page % 7 AS gx2 FROM b), j AS (SELECT b.*, gx1, gx2, (x2 - x1 >= 100 AND gx1 >= x1 + (x2 - x1) / 4::DOUBLE AND gx2 <= x2 - (x2 - x1) / 4::DOUBLE) AS cut FROM b JOIN g USING (page)) SELECT page, id, x1::BIGINT AS x1, CASE WHEN cut THEN gx1 ELSE x2 END::BIGINT AS x2 FROM j UNION ALL SELECT page, id, gx2::BIGINT, x2::BIGINT FROM j WHERE cut")
def img_11(spark, sf_dir):
    """Wide boxes cut at a gutter."""
    b = boxes(spark, sf_dir)
    g = b.select("page").distinct().select("page", (F.col("page") % 7 + 200).alias("gx1"), (F.col("page") % 7 + 230).alias("gx2"))
    return O.split_wide(b, g, spacing=100 / 28).select("page", "id", F.col("x1").cast("long").alias("x1"), F.col("x2").cast("long").alias("x2"))
