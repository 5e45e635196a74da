"""Queries over synthetic images, reports, sinks and token streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pixels as X
from ..operators import profiles as P
from ..sources import files, stages
from ..streaming import pages as S
from . import geometry, notation, profiles, progress, streams  # noqa: F401
from .registry import ORACLE, query, shared, table


@query("agg_19")
def agg_19(spark, sf_dir):
    """Robust line through each profile (iterative, one group a profile of fixed length)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        slope, base = X.robust_line(pdf["pos"].to_numpy(float), pdf["v"].to_numpy(float), delta=0.1)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "slope": [round(slope, 6)], "base": [round(base, 6)]})

    return profiles.profile(spark, sf_dir).groupBy("key").applyInPandas(fit, "key long, slope double, base double")


@query("joi_17", "SELECT p_partkey::VARCHAR AS stub, p_size * 2 AS m FROM part")
def joi_17(spark, sf_dir):
    """Batch inputs with their outputs: joined by key, whatever the order in which a batch comes back."""
    double = stages.Stage("double", "stub", "m int", lambda b: b.assign(m=b["n"] * 2)[["stub", "m"]].iloc[::-1])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stub"), F.col("p_size").alias("n"))
    return double.apply(rows).select("stub", "m")


@query("img_03")
def img_03(spark, sf_dir):
    """Skew with the fallback for pages that hold next to nothing."""
    p = streams._of_pages(spark, sf_dir, lambda i: (0.0 if i.size < 100 else X.skew(i),), "skew double")
    return p.withColumn("skew", F.round("skew", 3))


@query("img_08")
def img_08(spark, sf_dir):
    """Lines tracked outward from the centre of a profile, to either side."""
    p = profiles.profile(spark, sf_dir)
    right = P.ema(p.where("pos >= 32")).withColumnRenamed("last", "right")
    left = P.ema(p.where("pos <= 32").withColumn("pos", -F.col("pos"))).withColumnRenamed("last", "left")
    return right.join(left, "key").select("key", F.round("left", 9).alias("left"), F.round("right", 9).alias("right"))


@query("img_09", ORACLE["agg_18"].replace("AS slope", "AS tilt").replace("AS base", "AS offset_"))
def img_09(spark, sf_dir):
    """Tilt and offset of a crop from its displacements."""
    g = profiles.profile(spark, sf_dir).groupBy("key")
    return g.agg(F.round(F.regr_slope("v", "pos"), 9).alias("tilt"), F.round(F.regr_intercept("v", "pos"), 9).alias("offset_"))


@query("img_10", ORACLE["win_19"])
def img_10(spark, sf_dir):
    """Horizontal extent of a staff."""
    return profiles.win_19(spark, sf_dir)


@query("img_14", f"WITH {profiles._E} SELECT key, count_if(v > 0.12)::BIGINT AS bars, count_if(v > 0.12) >= 2 AS joined FROM e GROUP BY key")
def img_14(spark, sf_dir):
    """Barlines that join two staves: columns with ink enough between them."""
    g = profiles.profile(spark, sf_dir).groupBy("key").agg(F.count_if(F.col("v") > 0.12).alias("bars"))
    return g.select("key", "bars", (F.col("bars") >= 2).alias("joined"))


@query("img_15", ORACLE["win_20"])
def img_15(spark, sf_dir):
    """Where ledger lines end: the first run of empty rows."""
    return profiles.win_20(spark, sf_dir)


@query("img_16")
def img_16(spark, sf_dir):
    """Five-line staves of a page: row ink, islands of dark rows, evenly spaced fives."""
    p = streams._of_pages(spark, sf_dir, lambda i: (np.flatnonzero((i < 128).mean(1) > 0.5).tolist(),), "dark array<long>")
    rows = p.select(F.col("p_partkey").alias("key"), F.explode("dark").alias("pos"))
    lines = P.islands(rows, 2).select("key", F.col("first").alias("pos"))
    return P.five_lines(lines)


@query("img_18")
def img_18(spark, sf_dir):
    """Detected boxes whitened on their page; the masked page's ink is what is left."""

    def masked(img):
        left = img.copy()
        left[20:120, 20:460] = 255
        return int((left < 128).sum()), int((img < 128).sum())

    return streams._of_pages(spark, sf_dir, masked, "ink_left long, ink long")


@query("img_22", "SELECT (p_partkey // 6)::BIGINT AS batch, least(1485, greatest(32, (max(p_size * 9) + 31) // 32 * 32))::INTEGER AS h, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def img_22(spark, sf_dir):
    """The padded height of each batch of six."""
    g = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 6").alias("batch")).agg((F.ceil(F.max(F.col("p_size") * 9) / 32) * 32).cast("int").alias("m"), F.count("*").alias("n"))
    return g.select("batch", F.least(F.lit(1485), F.greatest(F.lit(32), "m")).alias("h"), "n")


@query("mth_12")
def mth_12(spark, sf_dir):
    """Mean of a page over its own background."""
    p = streams._of_pages(spark, sf_dir, lambda i: (float(X.divide_background(i).mean()),), "mean double")
    return p.withColumn("mean", F.round("mean", 3))


@query("snk_04", notation._REPORT + "SELECT '{\"doc\":' || doc || ',\"notes\":' || notes || ',\"rests\":' || rests || '}' AS js FROM s")
def snk_04(spark, sf_dir):
    """The light report: records without their pictures, as the lines of the JSON file."""
    r = notation.not_07(spark, sf_dir)
    folder = files.write_records(r.select("doc", F.col("note_count").alias("notes"), F.col("rest_count").alias("rests")), f"{shared(spark)}/report")
    return spark.read.text(folder).select(F.col("value").alias("js"))


@query("stm_06", "SELECT user_id AS page, count(*)::BIGINT AS chunks FROM events GROUP BY ALL UNION ALL VALUES (-1, 15), (-2, 15), (-3, 23)")
def stm_06(spark, sf_dir):
    """Token streams: chunks that a reply took; three replies of our own (pages below 0) loop and are stopped."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), n.alias("seq"), F.concat(F.lit("word"), F.col("event_id").cast("string"), F.lit(" ")).alias("chunk"))
    own = spark.range(3).select((-1 - F.col("id")).alias("page"), "id", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("seq"))
    own = own.select("page", "seq", F.when(F.col("seq") <= F.col("id") * 10, F.concat(F.lit("word"), F.col("seq").cast("string"), F.lit(" "))).otherwise("and so on again ").alias("chunk"))
    e, folder = e.unionByName(own.coalesce(1)), streams.shared(spark)
    e.write.parquet(f"{folder}/in")
    stream = S.files(spark, f"{folder}/in", e.schema, 100)  # each batch touches the state of every partition
    out = f"{folder}/replies"

    def keep(batch, i):
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

    S.each_batch(S.token_stream(stream), folder, keep, "update")
    return spark.read.parquet(out).groupBy("page").agg(F.max("chunks").cast("long").alias("chunks"))


@query("stm_09", ORACLE["top_02"])
def stm_09(spark, sf_dir):
    """The bounded log of a drained stream."""
    stream, folder = streams._stream(spark, table(spark, sf_dir, "events").select("event_id", "event_type", "ts"))
    return S.last_events(S.drain(stream, folder)).select("event_id", "event_type")


@query("api_06", "SELECT page_id, 'edited ' || page_id AS text FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, url FROM pages WHERE page_id % 2 = 1")
def api_06(spark, sf_dir):
    """Saved page texts outweigh recognised ones."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    saved = p.where("page_id % 2 = 0").select("page_id", F.format_string("edited %d", "page_id").alias("saved"))
    return p.join(saved, "page_id", "left").select("page_id", F.coalesce("saved", "text").alias("text"))


@query("api_08", f"WITH {geometry._B}, f AS (SELECT page, count(*) AS n, count_if(y2 - y1 >= 102) AS m FROM b GROUP BY page) SELECT page, n::BIGINT AS boxes, m::BIGINT AS monsters FROM f WHERE m > 0")
def api_08(spark, sf_dir):
    """The scan command: pages that are flagged."""
    g = geometry.boxes(spark, sf_dir).groupBy("page").agg(F.count("*").alias("boxes"), F.count_if(F.col("y2") - F.col("y1") >= 102).alias("monsters"))
    return g.where("monsters > 0")


@query("not_04", "SELECT user_id AS doc, true AS valid FROM events GROUP BY ALL")
def not_04(spark, sf_dir):
    """The default of the pluggable check of a healed text: even columns."""
    return streams.not_03(spark, sf_dir).select("doc", "valid")
