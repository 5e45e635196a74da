"""Validator, healing and column checks on worked examples."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import kern as K
from quirefold.operators import healing as H
from quirefold.operators import notation as N

CLEAN = "**kern\n*clefG2\n*M4/4\n=1\n4c\n4d\n4e\n4f\n=2\n4g\n4a\n4b\n4cc\n=3\n2c\n2d\n==\n*-"


def report(spark, text, width=500):
    return N.validate(spark.createDataFrame([(1, text, width)], "doc long, raw_kern string, crop_width int")).first()


def test_clean(spark):
    r = report(spark, CLEAN)
    assert r.is_valid and r.score == 1.0 and r.anomalies == [] and r.measure_count == 3 and r.note_count == 10 and r.signature == "4/4" and r.clefs == ["*clefG2"]


def test_imbalance(spark):
    r = report(spark, CLEAN.replace("4cc\n", "4cc\n4dd\n"))
    assert r.anomalies == ["DURATION_IMBALANCE"] and r.score == pytest.approx(0.9)


def test_density(spark):
    r = report(spark, "**kern\n*M4/4\n" + "16c\n16d\n" * 15 + "*-", 150)
    assert "EXCESSIVE_NOTE_DENSITY" in r.anomalies and not r.is_valid


def test_tablature_loops_and_nothing(spark):
    assert "TABLATURE_CONTAMINATION" in report(spark, CLEAN.replace("*clefG2", "*clefTAB\n*stria6")).anomalies
    assert "CONSECUTIVE_NOTE_LOOP" in report(spark, "**kern\n" + "4c\n" * 9 + "*-").anomalies
    for text in ("", None, "% [OMR Batch Error] x"):
        r = report(spark, text)
        assert (r.score, r.is_valid, r.anomalies) == (0.0, False, ["EMPTY_OR_ERROR"])
    assert "RESTS_ONLY" in report(spark, "**kern\n4r\n4r\n*-").anomalies


def test_voices(spark):
    two = "**kern\t**kern\n*M4/4\t*M4/4\n=1\t=1\n4c\t4e\n4d\t4f\n4e\t4g\n4f\t4a\n=2\t=2\n1c\t2e\n*-\t*-"
    assert "VOICE_DESYNCHRONIZATION" in report(spark, two).anomalies
    assert "DUPLICATE_VOICE" in report(spark, two.replace("4e\n4d", "4c\n4d").replace("4f\n4e", "4d\n4e").replace("4g\n4f", "4e\n4f").replace("4a\n", "4f\n").replace("2e", "1c")).anomalies


@pytest.mark.parametrize(("token", "beats"), [("4", 1.0), ("8.", 0.75), ("4..", 1.75), ("12c", 4 / 12), ("0", 4.0), (".", None), ("c", None), ("4c 4e", 1.0)])
def test_beats(spark, token, beats):
    got = spark.createDataFrame([(token,)], "t string").select(K.beats(F.col("t"))).first()[0]
    assert got == (pytest.approx(beats) if beats is not None else None)


SPINES = [
    (["**kern", "4c", "*-"], True),
    (["**kern", "*^", "4c\t4e", "*v\t*v", "4d", "*-"], True),
    (["**kern", "4c\t4d", "*-"], False),
    (["4c", "4d"], False),
    ([], False),
    (["**kern\t**kern", "*^\t4c"], False),
]


@pytest.mark.parametrize(("lines", "ok"), SPINES)
def test_spines(spark, lines, ok):
    assert spark.createDataFrame([(lines,)], "l array<string>").select(K.spines_valid(F.col("l"))).first()[0] is ok


@pytest.fixture(scope="module")
def cut(spark):
    return lambda t: H.cut_runaway(spark.createDataFrame([(1, t)], "doc long, raw_kern string")).first().kern


@pytest.fixture(scope="module")
def even(spark):
    return lambda t: H.normalise(spark.createDataFrame([(1, t)], "doc long, raw_kern string")).first().kern


def test_runaway(cut):
    assert cut("**kern\n4c\n4d\n==\n4e\n4f") == "**kern\n4c\n4d\n==\n*-"
    assert cut("**kern\n*M4/4\n=1\n4c\n4d\n=2\n8g\n8a\n=3\n4c\n4d\n=4\n8g\n8a").count("=") == 3
    assert "4e" not in cut("**kern\n=1\n4c\n4d\n4d\n4e")
    assert cut("") == "" and cut(None) is None
    assert "33333333" not in cut("**kern\n4c\n33333333\n4d")


CUTS = [
    ("**kern<b>4c<s>x<t>4d</s><b>*-", "**kern\n4c x\t4d\n*-"),
    ("  \n\t", "  \n\t"),
    ("777777c", "=\n*-"),
    ("**kern\n" + "*8va\n" * 3 + "4c", "**kern\n*8va\n=\n*-"),
    ("".join(f"*a{i}\n" for i in range(20)), "".join(f"*a{i}\n" for i in range(12)) + "=\n*-"),
    ("**kern\n4c\n*M3/4\n4d", "**kern\n4c\n=\n*-"),
    ("**kern\n4c\n*^\n4d\t4e", "**kern\n4c\n*^\n4d\t4e\n=\n*-"),
    ("**kern\t**kern\n=1\n4c\n=2\n4r\n=3\n.\n=4\n4d", "**kern\t**kern\n=1\n4c\n=2\n4r\n=3\n.\n=\t=\n*-\t*-"),
    ("=1\n4c\n!x\n4c\n4d", "!x\n=1\n4c\n=\n*-"),
    ("=1\n4c\n=2\n4c\n=3\n4e", "=1\n4c\n=2\n4c\n=3\n4e\n=\n*-"),
    ("=1\n4c\n=2\n4d\n=3\n4e\n=4\n4d\n=5\n4e", "=1\n4c\n=2\n4d\n=3\n4e\n=\n*-"),
    ("=1\n4a\n=2\n4c\n=3\n4c\n=4\n4c\n=5\n4c", "=1\n4a\n=2\n4c\n=\n*-"),
]


def test_normalise(spark, even):
    out = even("4c\t4e\n4d\n=1\n*clefTAB6\t*\n4f\t4g\t4a")
    lines = out.split("\n")
    assert lines[0] == "**kern\t**kern" and lines[-1] == "*-\t*-" and all(len(x.split("\t")) == 2 for x in lines)
    assert even("") is None and even(None) is None
    assert spark.createDataFrame([(lines,)], "l array<string>").select(K.spines_valid(F.col("l"))).first()[0]


EVEN = [
    ("**kern\n*^\n4c\n*v\t*v\n4d\t4e\n==", "**kern\n*^\n4c\t.\n*v\t*v\n4d\n==\n*-"),
    ("**kern\t**kern\n*v\n4c\n=2", "**kern\t**kern\n*\t*\n4c\t.\n=2\t=2\n*-\t*-"),
    ("**kern\n*stria5\n4c\t*^\n*^", "**kern\n4c\n*^\n=\t=\n*-\t*-"),
    ("**kern", "**kern\n=\n*-"),
    ("**kern\t**kern\t**kern\n*v\t*v\t*^\n4c\n==", "**kern\t**kern\t**kern\n*v\t*v\t*^\n4c\t.\t.\n==\t==\t==\n*-\t*-\t*-"),
]


def test_healing_of_many(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CUTS + EVEN)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc long, raw_kern string").repartition(3)
    got = {r.doc: r.kern for r in H.cut_runaway(docs).collect()}
    assert [got[i] for i in range(len(CUTS))] == [w for _, w in CUTS] and got[90] is None and got[91] == ""
    got = {r.doc: r.kern for r in H.normalise(docs).collect()}
    assert [got[len(CUTS) + i] for i in range(len(EVEN))] == [w for _, w in EVEN] and got[90] is None and got[91] is None
    assert H.cut_runaway(docs.where("false")).count() == 0 and H.normalise(docs.where("false")).count() == 0


def test_null_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc long, raw_kern string, crop_width int")
    assert N.validate(none).count() == 0
