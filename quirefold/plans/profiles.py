"""Profile queries. An embedding is a profile of 64 positions; events of a user are line centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P
from .registry import query, table

_E = "e AS (SELECT vec_id AS key, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_L = "l AS (SELECT user_id AS key, event_id AS pos FROM events)"


def profile(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))


def centres(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"))


def _r(c, n=9):
    return F.round(c, n)


@query("agg_08", f"WITH {_E} SELECT key, round(quantile_cont(v, 0.85), 9) AS p85, round(quantile_cont(v, 0.9), 9) AS p90 FROM e GROUP BY key")
def agg_08(spark, sf_dir):
    """Background percentiles, exact."""
    return profile(spark, sf_dir).groupBy("key").agg(_r(F.percentile("v", 0.85)).alias("p85"), _r(F.percentile("v", 0.9)).alias("p90"))


@query("agg_09", f"WITH {_E} SELECT key, round(median(v), 9) AS med FROM e GROUP BY key")
def agg_09(spark, sf_dir):
    """Median."""
    return profile(spark, sf_dir).groupBy("key").agg(_r(F.median("v")).alias("med"))


@query("agg_10", f"WITH {_E} SELECT key, round(avg(v + 2), 9) AS mean, round(stddev_pop(v), 9) AS sd, stddev_pop(v) / avg(v + 2) <= 0.06 AS even FROM e GROUP BY key")
def agg_10(spark, sf_dir):
    """Mean, population deviation and evenness."""
    g = profile(spark, sf_dir).groupBy("key").agg(F.avg(F.col("v") + 2).alias("m"), F.stddev_pop("v").alias("s"))
    return g.select("key", _r("m").alias("mean"), _r("s").alias("sd"), (F.col("s") / F.col("m") <= 0.06).alias("even"))


_Q = f"{_E}, q AS (SELECT key, pos, round(v * 20)::BIGINT AS b FROM e)"


@query("agg_11", f"WITH {_Q}, c AS (SELECT key, b, count(*) AS n FROM q WHERE b <> 0 GROUP BY ALL) SELECT key, b AS mode, n::BIGINT AS times FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, b) = 1")
def agg_11(spark, sf_dir):
    """Most frequent bin, the smallest of equals, bin 0 left out."""
    c = profile(spark, sf_dir).select("key", F.round(F.col("v") * 20).cast("long").alias("b")).where("b <> 0").groupBy("key", "b").agg(F.count("*").alias("n"))
    best = c.groupBy("key").agg(F.max(F.struct("n", (-F.col("b")).alias("nb"))).alias("x"))
    return best.select("key", (-F.col("x.nb")).alias("mode"), F.col("x.n").alias("times"))


@query("agg_13", f"WITH {_E} SELECT pos, count_if(v > 0)::BIGINT AS ink FROM e GROUP BY pos")
def agg_13(spark, sf_dir):
    """Ink by column over all rows."""
    return profile(spark, sf_dir).groupBy("pos").agg(F.count_if(F.col("v") > 0).alias("ink"))


@query("agg_14", f"WITH {_E} SELECT key, arg_max(pos, (v, -pos))::BIGINT AS top, arg_min(pos, (v, pos))::BIGINT AS low FROM e GROUP BY key")
def agg_14(spark, sf_dir):
    """Places of the largest and smallest value, the first of equals."""
    return profile(spark, sf_dir).groupBy("key").agg(F.max_by("pos", F.struct("v", -F.col("pos"))).alias("top"), F.min_by("pos", F.struct("v", "pos")).alias("low"))


@query("agg_18", f"WITH {_E} SELECT key, round(regr_slope(v, pos), 9) AS slope, round(regr_intercept(v, pos), 9) AS base FROM e GROUP BY key")
def agg_18(spark, sf_dir):
    """Least-squares line."""
    return profile(spark, sf_dir).groupBy("key").agg(_r(F.regr_slope("v", "pos")).alias("slope"), _r(F.regr_intercept("v", "pos")).alias("base"))


@query("win_01", "SELECT o_orderkey AS sheet, n::INTEGER AS pages, (sum(n) OVER (PARTITION BY book ORDER BY o_orderkey) - n + 1)::BIGINT AS first_page FROM (SELECT o_orderkey, o_custkey AS book, CASE WHEN w / greatest(1, h) BETWEEN 1.22 AND 2.2 AND h >= 300 THEN 2 ELSE 1 END AS n FROM (SELECT *, (300 + o_orderkey % 900)::DOUBLE AS w, (250 + o_orderkey % 377)::DOUBLE AS h FROM orders))")
def win_01(spark, sf_dir):
    """Book pages of each sheet: spreads have two."""
    return numbered(spark, sf_dir).select("sheet", "pages", "first_page")


def numbered(spark, sf_dir):
    from pyspark.sql import Window

    w, h = F.lit(300.0) + F.col("o_orderkey") % 900, F.lit(250.0) + F.col("o_orderkey") % 377
    spread = (w / F.greatest(F.lit(1), h)).between(1.22, 2.2) & (h >= 300)
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("sheet"), F.when(spread, 2).otherwise(1).alias("pages"))
    before = F.sum("pages").over(Window.partitionBy("book").orderBy("sheet").rowsBetween(Window.unboundedPreceding, 0)) - F.col("pages") + 1
    return s.withColumn("first_page", before.cast("long"))


@query("flt_01", "SELECT o_orderkey AS sheet FROM (SELECT *, (300 + o_orderkey % 900)::DOUBLE AS w, (250 + o_orderkey % 377)::DOUBLE AS h FROM orders) WHERE w / greatest(1, h) BETWEEN 1.22 AND 2.2 AND h >= 300")
def flt_01(spark, sf_dir):
    """Sheets that are spreads."""
    return numbered(spark, sf_dir).where("pages = 2").select("sheet")


_N = "n AS (SELECT o_custkey AS book, o_orderkey AS sheet, CASE WHEN w / greatest(1, h) BETWEEN 1.22 AND 2.2 AND h >= 300 THEN 2 ELSE 1 END AS n FROM (SELECT *, (300 + o_orderkey % 900)::DOUBLE AS w, (250 + o_orderkey % 377)::DOUBLE AS h FROM orders)), f AS (SELECT *, sum(n) OVER (PARTITION BY book ORDER BY sheet) - n + 1 AS first_page FROM n)"


@query("joi_18", f"WITH {_N} SELECT book, (first_page + i)::BIGINT AS page, sheet, CASE WHEN n = 1 THEN 'single' WHEN i = 0 THEN 'left' ELSE 'right' END AS side FROM (SELECT *, unnest(range(0, n)) AS i FROM f)")
def joi_18(spark, sf_dir):
    """Sheet and side of each page of a book."""
    x = numbered(spark, sf_dir).select("book", "sheet", "pages", "first_page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("i"))
    return x.select("book", (F.col("first_page") + F.col("i")).alias("page"), "sheet", F.when(F.col("pages") == 1, "single").when(F.col("i") == 0, "left").otherwise("right").alias("side"))


@query("joi_19", f"WITH {_N} SELECT sheet, (first_page + i)::BIGINT AS page, i::INTEGER AS image FROM (SELECT *, unnest(range(0, least(n, sheet % 2 + 1))) AS i FROM f)")
def joi_19(spark, sf_dir):
    """Split images with their pages, by place; what has no partner drops out."""
    pages = joi_18(spark, sf_dir).join(numbered(spark, sf_dir).select("sheet", "first_page"), "sheet").select("sheet", "page", (F.col("page") - F.col("first_page")).cast("int").alias("image"))
    images = numbered(spark, sf_dir).select("sheet", F.explode(F.sequence(F.lit(0), (F.col("sheet") % 2).cast("int"))).alias("image"))
    return pages.join(images, ["sheet", "image"]).select("sheet", "page", "image")


_S = "s AS (SELECT *, max((cnt > 0)::INT) OVER (PARTITION BY book ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM (SELECT o_custkey AS book, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS cnt, o_orderpriority = '5-LOW' AS multi FROM orders))"
_D = f"{_S}, d AS (SELECT *, greatest(5, n * 15 // 100) AS front, greatest(greatest(5, n * 15 // 100) + 1, n - n * 12 // 100 + 1) AS back FROM s), c AS (SELECT *, coalesce(started, 0) = 0 AND p <= front AS early, p >= back AND cnt = 0 AND NOT (coalesce(started, 0) = 0 AND p <= front) AS late FROM d), k AS (SELECT *, coalesce(max((late AND multi)::INT) OVER (PARTITION BY book ORDER BY p), 0) = 1 AS latched FROM c)"


def page_skips(pages):
    """Front pages before the first music, and back pages from the first index page on, are skipped.

    pages: (book, p, n, cnt, multi).  The two latches of the page filter as running maxima.
    """
    from pyspark.sql import Window

    from .text import back_start, front_limit

    by = Window.partitionBy("book").orderBy("p")
    started = F.coalesce(F.max(F.col("cnt") > 0).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    x = pages.withColumn("early", ~started & (F.col("p") <= front_limit(F.col("n"))))
    x = x.withColumn("late", (F.col("p") >= back_start(F.col("n"))) & (F.col("cnt") == 0) & ~F.col("early"))
    latched = F.coalesce(F.max(F.col("late") & F.col("multi")).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    reason = F.when(F.col("early") & (F.col("cnt") == 0), "front").when(F.col("late") & latched, "back").otherwise("keep")
    return x.withColumn("action", reason)


def detected(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("book").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), "o_orderkey", F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("cnt"), (F.col("o_orderpriority") == "5-LOW").alias("multi"))
    return o.withColumns({"p": F.row_number().over(by), "n": F.count("*").over(Window.partitionBy("book")).cast("int")})


@query("flt_04", f"WITH {_D} SELECT book, p::INTEGER AS p, CASE WHEN early AND cnt = 0 THEN 'front' WHEN late AND latched THEN 'back' ELSE 'keep' END AS action FROM k")
def flt_04(spark, sf_dir):
    """Which pages are skipped."""
    return page_skips(detected(spark, sf_dir)).select("book", F.col("p").cast("int").alias("p"), "action")


_I = f"{_L}, g AS (SELECT *, sum(CASE WHEN pos - prev <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY pos) AS island FROM (SELECT *, lag(pos) OVER (PARTITION BY key ORDER BY pos) AS prev FROM l))"


@query("win_02", f"WITH {_I} SELECT key, count(*)::BIGINT AS n, round(avg(pos), 6)::DOUBLE AS centre FROM g GROUP BY key, island")
def win_02(spark, sf_dir):
    """Clusters of line centres."""
    return P.islands(centres(spark, sf_dir), 40).select("key", "n", _r("mean", 6).alias("centre"))


@query("win_03", f"WITH {_I} SELECT key, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM g GROUP BY key, island")
def win_03(spark, sf_dir):
    """Segments with small gaps."""
    return P.islands(centres(spark, sf_dir), 40).select("key", "first", "last")


_R = f"{_E}, f AS (SELECT *, v > 0 AS lit, lag(v > 0) OVER (PARTITION BY key ORDER BY pos) AS prev FROM e), u AS (SELECT *, sum((lit IS DISTINCT FROM prev)::INT) OVER (PARTITION BY key ORDER BY pos) AS run FROM f), r AS (SELECT key, run, min(pos) AS a, max(pos) AS z, any_value(lit) AS lit, count(*) AS n FROM u GROUP BY key, run)"


@query("win_04", f"WITH {_R} SELECT key, max(n)::BIGINT AS longest FROM r WHERE NOT lit GROUP BY key")
def win_04(spark, sf_dir):
    """Longest run without ink."""
    return P.runs(profile(spark, sf_dir), F.col("v") > 0).where("not on").groupBy("key").agg(F.max("n").alias("longest"))


@query("win_05", f"WITH {_R} SELECT key, a::BIGINT AS start, lit, n::BIGINT AS n FROM r")
def win_05(spark, sf_dir):
    """All runs of ink and white."""
    return P.runs(profile(spark, sf_dir), F.col("v") > 0).select("key", "start", F.col("on").alias("lit"), "n")


@query("win_06", f"WITH {_E}, d AS (SELECT key, pos, v - lag(v) OVER (PARTITION BY key ORDER BY pos) AS d FROM e) SELECT key, pos, round(d, 9) AS d FROM d WHERE d IS NOT NULL")
def win_06(spark, sf_dir):
    """Differences of neighbours."""
    d = profile(spark, sf_dir).withColumn("d", F.col("v") - F.lag("v").over(P.order()))
    return d.where("d is not null").select("key", "pos", _r("d").alias("d"))


_K = f"{_E}, w AS (SELECT *, lag(v) OVER (PARTITION BY key ORDER BY pos) AS b, lead(v) OVER (PARTITION BY key ORDER BY pos) AS a FROM e)"


@query("win_07", f"WITH {_K} SELECT key, count_if(v > b AND v >= a)::BIGINT AS peaks, count_if(v <= b AND v <= a)::BIGINT AS valleys FROM w GROUP BY key")
def win_07(spark, sf_dir):
    """Numbers of peaks and valleys."""
    p = profile(spark, sf_dir)
    x = P.peaks(p).select("key", F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(P.valleys(p).select("key", F.lit(0).alias("p"), F.lit(1).alias("q")))
    return x.groupBy("key").agg(F.sum("p").alias("peaks"), F.sum("q").alias("valleys"))


@query("win_08")
def win_08(spark, sf_dir):
    """Peaks at least 6 apart, the highest first."""
    return P.kept_apart(P.peaks(profile(spark, sf_dir)), 6, F.col("v")).select("key", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query("win_09")
def win_09(spark, sf_dir):
    """Valleys over 35 from the last kept one."""
    return P.kept_apart(P.valleys(profile(spark, sf_dir)), 36).select("key", F.size("kept").alias("n"))


@query("flt_05")
def flt_05(spark, sf_dir):
    """Pages with two valleys or more that stand apart: columns of an index."""
    return win_09(spark, sf_dir).select("key", (F.col("n") >= 2).alias("multi_column"))


@query("srt_04", f"WITH {_K}, k AS (SELECT key, pos, v FROM w WHERE v > b AND v >= a) SELECT key, array_to_string(list(pos ORDER BY v DESC, pos)[1:5], ',') AS top5 FROM k GROUP BY key")
def srt_04(spark, sf_dir):
    """The five highest peaks."""
    p = P.peaks(profile(spark, sf_dir))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("o"), "pos"))), 1, 5)
    return p.groupBy("key").agg(F.array_join(F.transform(best, lambda x: x["pos"].cast("string")), ",").alias("top5"))


@query("win_10", f"WITH {_L}, a AS (SELECT *, [lead(pos, 1) OVER w - pos, lead(pos, 2) OVER w - lead(pos, 1) OVER w, lead(pos, 3) OVER w - lead(pos, 2) OVER w, lead(pos, 4) OVER w - lead(pos, 3) OVER w] AS d, lead(pos, 5) OVER w - lead(pos, 4) OVER w AS f, lead(pos, 4) OVER w AS l4 FROM l WINDOW w AS (PARTITION BY key ORDER BY pos)), m AS (SELECT *, list_sum(d) / 4::DOUBLE AS s FROM a WHERE l4 IS NOT NULL) SELECT key, pos, s::DOUBLE AS spacing FROM m WHERE s BETWEEN 5 AND 60 AND sqrt(list_sum(list_transform(d, lambda x: (x - s) * (x - s))) / 4) / s <= 0.5 AND NOT coalesce(abs(f - s) <= 0.3 * s, false)")
def win_10(spark, sf_dir):
    """Five even lines that no sixth goes on."""
    return P.five_lines(centres(spark, sf_dir), 5, 60, 0.5)


@query("win_11", f"WITH {_L}, a AS (SELECT key, pos, [lead(pos, 1) OVER w - pos, lead(pos, 2) OVER w - lead(pos, 1) OVER w, lead(pos, 3) OVER w - lead(pos, 2) OVER w, lead(pos, 4) OVER w - lead(pos, 3) OVER w, lead(pos, 5) OVER w - lead(pos, 4) OVER w] AS d FROM l WINDOW w AS (PARTITION BY key ORDER BY pos)) SELECT key, count(*)::BIGINT AS grids FROM a WHERE d[5] IS NOT NULL AND len(list_filter(d, lambda x: abs(x - list_sum(d) / 5::DOUBLE) > 0.9 * list_sum(d) / 5::DOUBLE)) = 0 GROUP BY key")
def win_11(spark, sf_dir):
    """Six evenly spaced lines: a table's grid."""
    p = [F.col("pos"), *(F.lead("pos", i).over(P.order()) for i in range(1, 6))]
    x = centres(spark, sf_dir).withColumn("d", F.array(*(p[i + 1] - p[i] for i in range(5)))).where(F.col("d")[4].isNotNull())
    x = x.withColumn("m", F.aggregate("d", F.lit(0).cast("long"), lambda a, v: a + v) / 5)
    return x.where(F.forall("d", lambda v: F.abs(v - F.col("m")) <= 0.9 * F.col("m"))).groupBy("key").agg(F.count("*").alias("grids"))


@query("win_17")
def win_17(spark, sf_dir):
    """Exponential tracking of a profile."""
    return P.ema(profile(spark, sf_dir)).select("key", _r("last").alias("last"))


@query("win_18", f"WITH {_E} SELECT key, pos, round(avg(v) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 9) AS v FROM e")
def win_18(spark, sf_dir):
    """Box smoothing."""
    return P.box_smooth(profile(spark, sf_dir)).select("key", "pos", _r("v").alias("v"))


@query("win_19", f"WITH {_L}, g AS (SELECT *, sum(CASE WHEN pos - prev <= 35 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY pos) AS island FROM (SELECT *, lag(pos) OVER (PARTITION BY key ORDER BY pos) AS prev FROM l)), i AS (SELECT key, min(pos) AS a, max(pos) AS z FROM g GROUP BY key, island) SELECT key, a::BIGINT AS left, z::BIGINT AS right FROM i WHERE a <= key * 60 AND key * 60 <= z".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def win_19(spark, sf_dir):
    """Extent of a staff from its anchor."""
    return P.trace(centres(spark, sf_dir), F.lit(True), F.col("key") * 60)


@query("win_20", f"WITH {_R} SELECT key, min(a)::BIGINT AS stops_at FROM r WHERE NOT lit AND n >= 3 AND a >= 20 GROUP BY key")
def win_20(spark, sf_dir):
    """The first three empty rows behind row 20."""
    r = P.runs(profile(spark, sf_dir), F.col("v") > 0).where((~F.col("on")) & (F.col("n") >= 3) & (F.col("start") >= 20))
    return r.groupBy("key").agg(F.min("start").alias("stops_at"))


@query("win_21", f"WITH {_E}, c AS (SELECT key, pos, avg((v > 0)::INT) OVER w AS share, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY key ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) SELECT key, pos, round(share, 9) AS share FROM c WHERE n = 10 QUALIFY row_number() OVER (PARTITION BY key ORDER BY c.share DESC, pos) = 1")
def win_21(spark, sf_dir):
    """The window of ten that has most ink."""
    return P.densest(profile(spark, sf_dir), F.col("v") > 0, 10).select("key", "pos", _r("share").alias("share"))


@query("flt_08", f"WITH {_E} SELECT key, avg((v < -0.2)::INT) < 0.05 AND avg(v) > -0.01 AS blank FROM e GROUP BY key")
def flt_08(spark, sf_dir):
    """Blank pages: hardly a dark pixel, and a light mean."""
    g = profile(spark, sf_dir).groupBy("key").agg(F.avg((F.col("v") < -0.2).cast("int")).alias("dark"), F.avg("v").alias("mean"))
    return g.select("key", ((F.col("dark") < 0.05) & (F.col("mean") > -0.01)).alias("blank"))


@query("flt_06", f"WITH {_R}, t AS (SELECT key, a, a - lag(a) OVER (PARTITION BY key ORDER BY a) AS d FROM r WHERE lit), m AS (SELECT key, count(*) AS lines, median(d) AS med FROM t GROUP BY key) SELECT key, lines::BIGINT AS lines, med::DOUBLE AS spacing, lines >= 5 AND med BETWEEN 4 AND 24 AS staff FROM m")
def flt_06(spark, sf_dir):
    """Is a crop a staff: five lines or more, spaced in bounds."""
    lines = P.runs(profile(spark, sf_dir), F.col("v") > 0).where("on").select("key", F.col("start").alias("pos"))
    d = lines.withColumn("d", F.col("pos") - F.lag("pos").over(P.order()))
    g = d.groupBy("key").agg(F.count("*").alias("lines"), F.median("d").alias("spacing"))
    return g.select("key", "lines", "spacing", ((F.col("lines") >= 5) & F.col("spacing").between(4, 24)).alias("staff"))


@query("set_05", f"WITH {_E} SELECT key, count_if(v > 0.15 OR abs(v) < 0.02)::BIGINT AS lit FROM e GROUP BY key")
def set_05(spark, sf_dir):
    """Either of two binarisations."""
    return profile(spark, sf_dir).groupBy("key").agg(F.count_if((F.col("v") > 0.15) | (F.abs("v") < 0.02)).alias("lit"))


@query("mth_11", "SELECT vec_id, round(embedding[1]::DOUBLE * x + embedding[2]::DOUBLE * x * x, 9) + 0.0::DOUBLE AS dy, x::BIGINT AS x FROM (SELECT vec_id, embedding, unnest(range(0, 20)) AS x FROM embeddings)")
def mth_11(spark, sf_dir):
    """A displacement curve over columns."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("k"), F.col("embedding")[1].cast("double").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("x"))
    return e.select("vec_id", (_r(F.col("k") * F.col("x") + F.col("a") * F.col("x") * F.col("x")) + F.lit(0.0)).alias("dy"), "x")


@query("arr_01", "SELECT vec_id, i::INTEGER AS chunk, round(list_sum(embedding[i * 6 + 1:i * 6 + 6]::DOUBLE[]), 6) AS total FROM (SELECT vec_id, embedding, unnest(range(0, 11)) AS i FROM embeddings)")
def arr_01(spark, sf_dir):
    """Chunks of six of an array."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("chunk"))
    part = F.slice("e", F.col("chunk") * 6 + 1, 6)
    return e.select("vec_id", "chunk", _r(F.aggregate(part, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))
