"""Assembly, boxes, profiles, pixels, streams and stages on worked examples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.operators import assembly as A
from quirefold.operators import boxes as O
from quirefold.operators import pixels as X
from quirefold.operators import profiles as P
from quirefold.sources import stages
from quirefold.streaming import pages as S

BOX = "page long, id long, x1 int, y1 int, x2 int, y2 int, conf double, cls string"


def test_injection(spark):
    pages = spark.createDataFrame([(1, "# Title\n<!-- MUSIC_STUB_ID: a -->mid<!-- MUSIC_STUB_ID: b -->\nFooter"), (2, "no tags"), (3, None)], "page long, text string")
    notes = spark.createDataFrame([(1, "a", "X:1\nK:C", None), (1, "c", "X:2", "**kern"), (1, "d", "% [OMR Conversion Error", None)], "page long, stub string, abc string, kern string")
    stubs = spark.createDataFrame([(1, s) for s in "abcd"], "page long, stub string")
    got = {r.page: r.text for r in A.inject(pages, notes, stubs).collect()}
    assert got[1] == (
        "# Title\n\n\n```abc\nX:1\nK:C\n```\n\nmid\n\n<!-- MUSIC_STUB_ID: b (Notes not found, awaiting OMR) -->\n\n\nFooter"
        "\n\n<!-- RECOVERED_MUSIC_STUBS -->\n\n```abc\nX:2\n```\n\n```kern\n**kern\n```\n"
    )
    assert got[2] == "no tags"


def test_book_order(spark):
    rows = [("b", 2, "two"), ("b", 1, "one"), ("b", 10, None)]
    assert A.book(spark.createDataFrame(rows, "book string, page int, text string")).first().text == "<!-- PAGE 0001 -->\none\n\n---\n\n<!-- PAGE 0002 -->\ntwo\n\n---\n\n<!-- PAGE 0010 -->\n"


def test_heal(spark):
    rows = [(1, 1, 100, 200, 400, 260, 0.9, "staff"), (1, 2, 410, 202, 700, 262, 0.85, "staff"), (1, 3, 100, 600, 400, 660, 0.8, "staff")]
    got = sorted((r.x1, r.x2) for r in O.heal(spark.createDataFrame(rows, BOX)).collect())
    assert got == [(100, 400), (100, 700)]


def test_suppress_and_contained(spark):
    rows = [(1, 1, 0, 0, 100, 50, 0.9, "a"), (1, 2, 5, 0, 100, 50, 0.8, "a"), (1, 3, 0, 200, 100, 250, 0.7, "a"), (1, 4, 20, 210, 40, 220, 0.6, "a")]
    b = spark.createDataFrame(rows, BOX)
    assert {r.id for r in O.suppress(b).collect()} == {1, 3, 4}
    assert {r.id for r in O.not_contained(b).collect()} == {3}  # 1 and 2 contain each other


def test_pairs_need_no_common_band_twice(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), i, *(x := rng.integers(0, 400, 2)).tolist(), *(x + rng.integers(5, 300, 2)).tolist(), 0.5, "a") for i in range(80)]
    got = sorted((r.a_id, r.b_id) for r in O.pairs(spark.createDataFrame(rows, BOX)).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and min(a[5], b[5]) > max(a[3], b[3]))
    assert got == want


def test_profiles(spark):
    v = [0, 1, 0, 5, 5, 0, 2, 0, 0, 0, 3, 0]
    p = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "key long, pos long, v double")
    assert [r.pos for r in P.peaks(p).orderBy("pos").collect()] == [1, 3, 6, 10]  # a plateau counts where it begins
    assert P.kept_apart(P.peaks(p), 4, F.col("v")).first().kept == [3, 10]
    assert [(r.start, r.n) for r in P.runs(p, F.col("v") > 0).where("on").orderBy("start").collect()] == [(1, 1), (3, 2), (6, 1), (10, 1)]
    assert tuple(P.densest(p, F.col("v") > 0, 2).first()) == (1, 3, 1.0)
    lines = spark.createDataFrame([(1, y) for y in (30, 42, 54, 66, 78)] + [(2, y) for y in range(0, 72, 12)], "key long, pos long")
    assert [(r.key, r.pos, r.spacing) for r in P.five_lines(lines).collect() if r.key == 1] == [(1, 30, 12.0)]


def staff(h=120, w=600):
    img = np.full((h, w), 255, np.uint8)
    for y in (30, 42, 54, 66, 78):
        img[y : y + 2, 20:580] = 0
    return img


def test_pixels(spark):
    assert X.spacing(staff()) == 12.0
    spread = np.full((800, 1200), 255, np.uint8)
    spread[:, 40:560] = spread[:, 640:1160] = 90
    assert abs(X.split_column(spread) - 600) <= 2
    for h, w in ((1000, 700), (500, 1500), (150, 800)):
        assert X.split_column(np.full((h, w), 255, np.uint8)) is None
    for angle in (-6.0, 4.0):
        turned = X.rotate(np.kron(np.tile([[255], [255], [255], [0]], (20, 64)), np.ones((4, 4))).astype(np.uint8), angle)
        assert abs(abs(X.skew(turned)) - abs(angle)) < 1.0
    assert X.rotate(staff(), 0.01) is not None and (X.divide_background(np.full((40, 40), 200, np.uint8)) >= 254).all()
    slope, base = X.robust_line(np.arange(20.0), np.where(np.arange(20) == 7, 500.0, 2 * np.arange(20.0) + 1))
    assert abs(slope - 2) < 0.2 and abs(base - 1) < 3
    rows = spark.createDataFrame([(120, 600, staff().tobytes()), (120, 600, None)], "h int, w int, d binary")
    assert {r[0] for r in rows.select(X.spacing_of(F.col("h"), F.col("w"), F.col("d"))).collect()} == {12.0, None}


def test_stage_contract(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "stub string, n int")
    ok = stages.Stage("double", "stub", "m long", lambda p: pd.DataFrame({"stub": p["stub"], "m": p["n"] * 2}))
    assert sorted(map(tuple, ok.apply(df).collect())) == [("a", 2, "success", None), ("b", 4, "success", None)]
    assert {r.status for r in stages.TRANSCRIBE.apply(df).collect()} == {"error"}


def test_stream_resumes(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long")
    df.where("id < 20").repartition(4).write.parquet(str(tmp_path / "in"))
    first = S.drain(S.files(spark, str(tmp_path / "in"), df.schema, 2), str(tmp_path / "work"))
    assert first.count() == 20
    df.where("id >= 20").write.mode("append").parquet(str(tmp_path / "in"))
    assert S.drain(S.files(spark, str(tmp_path / "in"), df.schema, 2), str(tmp_path / "work")).count() == 30


def test_stateful_filter_keeps_state_over_batches(spark, tmp_path):
    from quirefold.plans.profiles import page_skips

    rows = [(b, p, 100, int(p in (7, 40) and b == 1), p >= 92) for b in (1, 2) for p in range(1, 101)]
    schema = "book long, p int, n int, cnt int, multi boolean"
    for part in range(4):
        spark.createDataFrame([r for r in rows if (r[1] - 1) // 25 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.createDataFrame(rows, schema)
    out = S.drain(S.page_filter(S.files(spark, str(tmp_path / "in"), df.schema, 1)), str(tmp_path / "work"))
    want = page_skips(df).select("book", "p", "action")
    assert out.count() == 200 and out.exceptAll(want).count() == 0


@pytest.mark.parametrize("name", ["not_07", "not_07_voices", "agg_01", "joi_12", "win_02", "flt_04", "src_01", "src_02", "src_06", "src_07", "src_08", "src_09", "src_10", "snk_06", "con_01", "con_02", "con_04", "stm_08", "api_07", "api_11", "not_05", "not_06", "not_08"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    from quirefold import plans

    for t in ("events", "conversations", "lineitem", "orders", "customer", "supplier", "part", "documents", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert plans.QUERIES[name](spark, str(tmp_path)).count() == 0
