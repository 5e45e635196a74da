"""Streaming, healing, pixel and stage queries."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from ..operators import healing as H
from ..operators import pixels as X
from ..sources import stages
from ..streaming import pages as S
from . import notation, profiles
from .registry import ORACLE, query, shared, table


def _stream(spark, df):
    folder = shared(spark)
    df.write.parquet(f"{folder}/in")
    return S.files(spark, f"{folder}/in", df.schema), folder


@query("stm_01", "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def stm_01(spark, sf_dir):
    """A file stream drained once, then summed."""
    stream, folder = _stream(spark, table(spark, sf_dir, "events").select("event_id", "event_type", "value"))
    return S.drain(stream, folder).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stm_02", "SELECT count(*)::BIGINT AS n FROM events")
def stm_02(spark, sf_dir):
    """Micro-batches of at most six files, each handed to a sink that can be repeated."""
    df = table(spark, sf_dir, "events").select("event_id").repartition(8)
    stream, folder = _stream(spark, df)
    S.each_batch(stream, folder, lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/batch={i}"))
    return spark.read.parquet(f"{folder}/batch=*").agg(F.count("*").alias("n"))


@query("stm_05", ORACLE["flt_04"])
def stm_05(spark, sf_dir):
    """The page filter with state equals the batch filter."""
    stream, folder = _stream(spark, profiles.detected(spark, sf_dir).select("book", "p", "n", "cnt", "multi"))
    return S.drain(S.page_filter(stream), folder)


@query("not_02")
def not_02(spark, sf_dir):
    """Runaway kern texts cut."""
    return H.cut_runaway(notation.kern_docs(spark, sf_dir)).select("doc", "kern")


@query("not_03")
def not_03(spark, sf_dir):
    """Kern texts with even columns."""
    from ..functions.kern import spines_valid

    n = H.normalise(notation.kern_docs(spark, sf_dir))
    return n.select("doc", F.length("kern").alias("n"), spines_valid(F.split("kern", "\n")).alias("valid"))


def _page(key: int):
    """A synthetic page: five dark lines for each of a few staves, at a spacing by its key."""
    import numpy as np

    img = np.full((320, 480), 240, np.uint8)
    gap = 6 + int(key) % 9
    for top in range(30, 280, 12 * gap):
        for i in range(5):
            if top + i * gap < 318:
                img[top + i * gap : top + i * gap + 2, 30:450] = 20
    img[:, 236:244] = 240
    return img


def _of_pages(spark, sf_dir, fn, kind: str):
    """(p_partkey, columns of kind): what fn says of a page for every part."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"))
    return X.looked_at(parts.repartition(8 * spark.sparkContext.defaultParallelism), _page, fn, kind)


@query("img_01")
def img_01(spark, sf_dir):
    """Where a spread is cut."""
    return _of_pages(spark, sf_dir, lambda i: (X.split_column(i),), "cut int")


@query("img_02")
def img_02(spark, sf_dir):
    """Skew by the spectrum."""
    return _of_pages(spark, sf_dir, lambda i: (X.skew(i),), "skew double").withColumn("skew", F.round("skew", 3))


@query("img_04")
def img_04(spark, sf_dir):
    """Deskewed pages."""
    return _of_pages(spark, sf_dir, lambda i: (len(X.rotate(i, X.skew(i)).tobytes()),), "n int")


@query("img_05")
def img_05(spark, sf_dir):
    """Staff spacing of a page."""
    return _of_pages(spark, sf_dir, lambda i: (X.spacing(i),), "spacing double")


@query("img_20")
def img_20(spark, sf_dir):
    """Background division."""
    return _of_pages(spark, sf_dir, lambda i: (md5(X.divide_background(i).tobytes()).hexdigest(),), "md5 string")


@query("oe_stages")
def oe_stages(spark, sf_dir):
    """The contract of external stages: error rows where the model is absent."""
    stubs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stub"))
    return stages.TRANSCRIBE.apply(stubs).select("stub", "status", "error")


@query("src_04", "SELECT p_partkey::VARCHAR AS sheet, 'error' AS status, 'RuntimeError: pdf rasteriser is not installed' AS error FROM part")
def src_04(spark, sf_dir):
    """The rasteriser's contract: each sheet comes back, with an error where no rasteriser is installed."""
    sheets = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sheet"))
    return stages.RASTERISE.apply(sheets).select("sheet", "status", "error")


@query("img_21", "SELECT p_partkey::VARCHAR AS stub, 'error' AS status, 'RuntimeError: super resolution is not installed' AS error FROM part")
def img_21(spark, sf_dir):
    """The enlarger's contract: each crop comes back, with an error where no model is installed."""
    stubs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stub"))
    return stages.ENHANCE.apply(stubs).select("stub", "status", "error")
