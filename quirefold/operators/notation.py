"""Structural validation of kern documents, in DataFrame operators from lines to a report.

Input: (doc, raw_kern, crop_width).  Lines become rows; measures are a running count of
barlines, voice durations a sum by measure and spine, loops islands of equal pitches.
Everything is partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kern import beats, expected_beats, pitch
from ..functions.rounding import round_even
from ..functions.text import strip


def by_line():
    return Window.partitionBy("doc").orderBy("pos")


def kern_lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, line, kind, bars): non-empty lines without comments; bars counts the barlines up to a line."""
    lines = docs.select("doc", F.posexplode(F.split("raw_kern", "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("!"))
    kind = F.when(F.col("line").startswith("*"), "*").when(F.col("line").startswith("="), "=").otherwise("data")
    lines = lines.withColumn("kind", kind)
    return lines.withColumn("bars", F.sum((F.col("kind") == "=").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))


def voices(lines: DataFrame) -> DataFrame:
    """(doc, bars, spine, beats): summed durations of each voice of each measure."""
    data = lines.where("kind = 'data'").select("doc", "bars", F.posexplode(F.split("line", "\t")).alias("spine", "token"))
    return data.groupBy("doc", "bars", "spine").agg(F.coalesce(F.sum(beats(F.col("token"))), F.lit(0.0)).alias("beats"))


def measures(voice: DataFrame) -> DataFrame:
    """(doc, measure, last, beats, desync): the first voice's beats, and whether active voices differ by over 0.35."""
    active = F.when(F.col("beats") > 0, round_even(F.col("beats"), 3))
    per = voice.groupBy("doc", "bars").agg(
        round_even(F.sum(F.when(F.col("spine") == 0, F.col("beats"))), 3).alias("beats"),
        ((F.max("spine") > 0) & (F.count(active) > 1) & (F.max(active) - F.min(active) > 0.35)).alias("desync"),
    )
    order = Window.partitionBy("doc").orderBy("bars")
    return per.select("doc", F.row_number().over(order).alias("measure"), (F.count("*").over(Window.partitionBy("doc"))).alias("last"), "beats", "desync")


def longest_run(lines: DataFrame) -> DataFrame:
    """(doc, tokens, run): first-voice tokens but '.', and the longest run of equal non-empty pitches."""
    first = lines.where("kind = 'data'").select("doc", "pos", F.split("line", "\t")[0].alias("token")).where("token <> '.'")
    first = first.withColumn("p", pitch(F.col("token")))
    same = (F.col("p") != "") & (F.col("p") != ".") & F.col("p").eqNullSafe(F.lag("p").over(by_line()))
    island = first.withColumn("island", F.sum((~same).cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc", "island").agg(F.count("*").alias("n")).groupBy("doc").agg(F.sum("n").alias("tokens"), F.max("n").alias("run"))


def _header(lines: DataFrame) -> DataFrame:
    """(doc, clefs, signature): clefs first seen first, the last time signature."""
    marks = lines.where("kind = '*'").select("doc", "pos", F.posexplode(F.split("line", "\t")).alias("spine", "t"))
    marks = marks.where("t like '*clef%' or t rlike '^\\\\*M[0-9]'")
    clefs = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").like("*clef%"), F.struct("pos", "spine", "t")))), lambda x: x["t"]))
    signature = F.max_by(F.substring("t", 3, 1 << 20), F.when(F.col("t").like("*M%"), F.struct("pos", "spine")))
    return marks.groupBy("doc").agg(clefs.alias("clefs"), signature.alias("signature"))


def common_beats(per_measure: DataFrame) -> DataFrame:
    """(doc, common, times): the most frequent rounded duration, the first seen of equals."""
    rounded = per_measure.where("beats > 0").withColumn("b", round_even(F.col("beats"), 1))
    counted = rounded.groupBy("doc", "b").agg(F.count("*").alias("n"), F.min("measure").alias("at"))
    return counted.groupBy("doc").agg(F.max_by("b", F.struct("n", -F.col("at"))).alias("common"), F.max("n").alias("times"))


def _label(ok: Column, name: str) -> Column:
    return F.when(ok, F.lit(name))


def validate(docs: DataFrame, spines_ok: Column | None = None) -> DataFrame:
    """One report for each document: score, is_valid, anomaly kinds, counts, signature, clefs, density.

    spines_ok: the verdict on the healed text's columns (true where not given, as for
    documents without splits and merges, which healing always makes even).  The external
    engraver's verdict is no part of it.
    """
    docs = docs.withColumn("spines_ok", spines_ok if spines_ok is not None else F.lit(True))
    lines = kern_lines(docs)
    first = F.split("line", "\t")[0]
    rest = (first != ".") & first.contains("r")
    counts = lines.where("kind = 'data'").groupBy("doc").agg(
        F.count_if(rest).alias("rests"),
        F.count_if((first != ".") & ~first.contains("r") & F.lower(first).rlike("[a-g]")).alias("notes"),
        ((F.count_if(F.size(F.split("line", "\t")) >= 2) > 0) & (F.count_if((F.size(F.split("line", "\t")) >= 2) & (F.split("line", "\t")[0] != F.try_element_at(F.split("line", "\t"), F.lit(2)))) == 0)).alias("twin"),
    )
    per = measures(voices(lines))
    head, common = _header(lines), common_beats(per)
    judged = per.join(head.select("doc", expected_beats(F.col("signature")).alias("expected")), "doc", "left").join(common, "doc", "left")
    edge = (F.col("measure") == 1) | (F.col("measure") == F.col("last"))
    off_signature = (F.abs(F.col("beats") - F.col("expected")) > 0.30) & ~(edge & (F.col("beats") < F.col("expected")))
    off_common = (F.col("last") >= 3) & (F.col("times") >= 2) & ~edge & (F.abs(F.col("beats") - F.col("common")) > 0.40)
    off = F.when(F.col("expected") > 0, off_signature).when(F.col("expected").isNull(), off_common).otherwise(False)
    rhythm = judged.groupBy("doc").agg(F.count("*").alias("measures"), F.count_if(F.coalesce(off, F.lit(False))).alias("imbalanced"), F.count_if("desync").alias("desynced"))
    x = docs.join(counts, "doc", "left").join(rhythm, "doc", "left").join(longest_run(lines), "doc", "left").join(head, "doc", "left")
    x = x.na.fill(0, ["rests", "notes", "measures", "imbalanced", "desynced", "tokens", "run"]).na.fill(False, ["twin"])
    w, notes, rests = F.col("crop_width"), F.col("notes"), F.col("rests")
    x = x.withColumn("density", F.when(w > 0, notes / w * 100.0).otherwise(0.0))
    tab = F.col("raw_kern").contains("*clefTAB") | F.col("raw_kern").contains("*stria")
    crowded, dense = (w > 0) & (w < 250) & (notes > 20), (w > 0) & (F.col("density") > 18.0) & (w < 400)
    dropped, sparse = (w >= 600) & (notes == 0), (w >= 800) & (notes <= 1) & (rests <= 1)
    missing = F.coalesce(strip(F.col("raw_kern")) == "", F.lit(True)) | F.col("raw_kern").startswith("% [OMR")
    rules = [  # (holds, name, penalty)
        (~F.col("spines_ok"), "SPINE_MISALIGNMENT", F.lit(0.5)),
        (tab, "TABLATURE_CONTAMINATION", F.lit(0.4)),
        (F.col("desynced") > 0, "VOICE_DESYNCHRONIZATION", F.least(F.lit(0.35), 0.1 * F.col("desynced"))),
        (F.col("twin"), "DUPLICATE_VOICE", F.lit(0.25)),
        (F.col("imbalanced") > 0, "DURATION_IMBALANCE", F.least(F.lit(0.35), 0.1 * F.col("imbalanced"))),
        ((notes == 0) & (rests == 0), "ZERO_NOTES_DETECTED", F.lit(0.85)),
        ((notes == 0) & (rests > 0), "RESTS_ONLY", F.lit(0.4)),
        (crowded, "EXCESSIVE_NOTE_DENSITY", F.lit(0.4)),
        (~crowded & dense, "HIGH_NOTE_DENSITY", F.lit(0.3)),
        (dropped, "DROPPED_STAFF", F.lit(0.45)),
        (~dropped & sparse, "SPARSE_DROPPED_STAFF", F.lit(0.35)),
        ((F.col("tokens") >= 8) & (F.col("run") >= 8), "CONSECUTIVE_NOTE_LOOP", F.lit(0.35)),
    ]
    penalty = sum((F.when(F.coalesce(ok, F.lit(False)), p).otherwise(0.0) for ok, _, p in rules), F.lit(0.0))
    kinds = F.array_compact(F.array(*(_label(F.coalesce(ok, F.lit(False)), name) for ok, name, _ in rules)))
    score = F.when(missing, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty)), 6))
    x = x.withColumn("score", score).withColumn("anomalies", F.when(missing, F.array(F.lit("EMPTY_OR_ERROR"))).otherwise(kinds))
    fatal = F.arrays_overlap("anomalies", F.array(F.lit("SPINE_MISALIGNMENT"), F.lit("DROPPED_STAFF")))
    return x.select("doc", "score", (~missing & (F.col("score") >= 0.65) & ~fatal).alias("is_valid"), "anomalies", F.col("measures").cast("long").alias("measure_count"), notes.cast("long").alias("note_count"), rests.cast("long").alias("rest_count"), F.col("imbalanced").cast("long").alias("imbalanced"), F.col("run").cast("long").alias("longest_run"), "signature", F.coalesce("clefs", F.array().cast("array<string>")).alias("clefs"), F.round("density", 6).alias("density"))


def signatures(lines: DataFrame) -> DataFrame:
    """(doc, measure, sig): the set of pitch letters of each measure's tokens, in measure order."""
    from ..functions.kern import letters

    data = lines.where("kind = 'data'").select("doc", "bars", F.explode(F.split("line", "\t")).alias("token"))
    sets = data.groupBy("doc", "bars").agg(F.array_sort(F.collect_set(F.nullif(letters(F.col("token")), F.lit("")))).alias("sig"))
    return sets.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("bars")).alias("measure"), "sig")
