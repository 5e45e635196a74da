"""Servers, event streams, rates, conversions, staff crops and runs on worked examples and against plain loops."""

import json
import random
import urllib.error

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quirefold.operators import convert as C
from quirefold.operators import staves as V
from quirefold.operators.pixels import rotate, skew
from quirefold.sources import client as L
from quirefold.sources.stages import Stage, absent
from quirefold.streaming import control as R
from quirefold.streaming import pages as S


def test_servers(spark):
    bodies = {
        "a" + L.NATIVE: '{"models": [{"key": "m"}]}',
        "b" + L.COMPATIBLE: '{"data": [{"id": "x"}, {"id": "y"}]}',
        "c" + L.NATIVE: "{}",
        "d" + L.NATIVE: "[1]",
    }

    def fetch(url):
        if url not in bodies:
            raise urllib.error.URLError("refused") if url[0] != "e" else ValueError("odd")
        return bodies[url]

    urls = spark.createDataFrame([(u,) for u in "abcdef"], "url string")
    got = {r.url: (r.online, r.message, [m.key for m in r.models]) for r in L.probe(L.asking(fetch).apply(urls)).collect()}
    assert got == {
        "a": (True, "Server reachable (1 models available)", ["m"]),
        "b": (True, "VLM server reachable (2 models available)", ["x", "y"]),
        "c": (True, "Server reachable (0 models available)", []),
        "d": (False, "Connection error to d: refused", []),
        "e": (False, "Failed to connect to server: odd", []),
        "f": (False, "Connection error to f: refused", []),
    }


def shown(deltas):
    """The visible chunks of one reply, by a plain loop with one flag."""
    inside, out = False, []
    for d in deltas:
        head, mark, _ = d.partition("<think>")
        inside = inside or bool(mark)
        if inside:
            _, close, rest = head.partition("</think>")
            inside, d = not close, rest
        out += [d] if d else []
    return out


def test_event_streams(spark):
    rng = random.Random(5)
    words = ["a", "<think>", "</think>", "b<think>c", "d</think>e", "<think>f</think>g", "h</think>i<think>j", "</think>k</think>"]
    replies = {n: [rng.choice(words) for _ in range(rng.randrange(12))] for n in range(60)}
    line = lambda d: "data: " + json.dumps({"choices": [{"delta": {"content": d}}]})
    rows = [(n, i, line(d)) for n, ds in replies.items() for i, d in enumerate(ds)]
    got = {}
    for r in L.visible(L.deltas(spark.createDataFrame(rows, "reply long, seq long, line string"))).orderBy("reply", "seq").collect():
        got.setdefault(r.reply, []).append(r.delta)
    assert got == {n: s for n, ds in replies.items() if (s := shown(ds))}
    odd = [": ping", "", None, "data: {oops", '  data: {"choices":[]}', 'data: {"choices":[{"delta":{"reasoning_content":"r","content":null}}]}', line("x"), "data: [DONE]", line("late")]
    rows = [(1, i, x) for i, x in enumerate(odd)]
    assert [r.delta for r in L.deltas(spark.createDataFrame(rows, "reply long, seq long, line string")).collect()] == ["x"]


def test_rates_and_heartbeats(spark):
    rng = random.Random(3)
    rows = [(k, round(rng.random() * 9, 2), rng.randrange(10**6), 10**7) for k in "ab" for _ in range(80)] + [("c", 1.0, 5, 9), (None, 1.0, 1, 1), ("d", None, 1, 1)]
    df = spark.createDataFrame(rows, "file string, at double, done long, total long")
    want, speed = [], {}
    for k in "abc":
        kept = []
        for _, at, done, total in sorted(r for r in rows if r[0] == k):
            if not kept or at - kept[-1][0] >= 0.5:
                if kept:
                    s = (done - kept[-1][1]) / 2**20 / (at - kept[-1][0])
                    speed[k, at] = (s, (total - done) / (s * 2**20) if s > 0 else 0.0)
                kept.append((at, done))
        want += [(k, *x) for x in kept]
    assert sorted((r.file, r["at"], r.done) for r in L.spaced(df, "file", "at", 0.5).collect()) == sorted(want)
    got = {(r.file, r["at"]): (r.speed, r.eta) for r in L.rates(df).collect()}
    assert got.keys() == speed.keys() and all(got[k] == pytest.approx(speed[k]) for k in speed)
    beats = spark.createDataFrame([("w", i) for i in range(120)], "worker string, seq long").withColumn("poll", L.drained_by())
    assert {r.poll: r["count"] for r in beats.groupBy("poll").count().collect()} == {0: 50, 1: 50, 2: 20}


def test_scores(spark):
    rows = [("a", "My", ["C", "z"]), ("b", None, ["C"] * 40), ("c", "", None), ("d", "T2", ["C"])]
    df = spark.createDataFrame(rows, "stub string, title string, events array<string>")
    fn = lambda b: pd.DataFrame({"stub": ["d"], "abc": ["X:1\nT:Music21 Fragment\nT:old\nC:Music21\nK:C\nc"]})
    got = {r.stub: (r.abc, r.attempt) for r in C.to_abc(df, (absent("x", "stub", "abc string"), Stage("s", "stub", "abc string", fn))).collect()}
    head = "X:1\n{}L:1/4\nM:none\nI:linebreak $\nK:C\nV:1 treble\nV:1\n{} |"
    assert got == {"a": (head.format("T:My\n", "C z"), None), "b": (head.format("", " ".join(["C"] * 32)), None), "c": (head.format("", "z4"), None), "d": ("X:1\nT:T2\nK:C\nc", 1)}
    none = spark.createDataFrame([("A:x\nK:C",)], "abc string").select(C.clean_score(F.col("abc"), F.lit("t")).alias("x"))
    assert none.first().x == "A:x\nK:C"  # no X: line, so no place for a title


def test_svg_roots(spark):
    inner = '<svg class="definition-scale" viewBox="0 0 4 5"><g/></svg>'
    far = f'<svg id="{"y" * 220}">{inner}</svg>\n'
    rows = [(f"<svg a='1'>{inner}</svg>",), (far,), ("<svg/>",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(C.flat_svg(F.col("s"))).collect()]
    group = '<g class="definition-scale" viewBox="0 0 4 5"><g/></g>'
    assert got == [f"<svg a='1'>{group}</svg>", f'<svg viewBox="0 0 4 5" id="{"y" * 220}">{group}</svg>\n', "<svg/>", "", None]


def staff(h=200, w=600, top=60, gap=12):
    img = np.full((h, w), 245, np.uint8)
    for i in range(5):
        img[top + i * gap : top + i * gap + 2, 20 : w - 20] = 10
    return img


def test_skeleton_drops_what_is_no_line():
    img = staff()
    img[40:130, 200:203] = 10  # a stem
    img[80:92, 300:316] = 10  # a head
    lines, thick, space, rows = V.skeleton(img)
    assert (thick, space, rows) == (2, 10, [60, 72, 84, 96, 108])
    assert not lines[45:58, 200].any() and not lines[86:90, 305].any() and lines[60, 201]
    assert V.skeleton(np.full((100, 200), 255, np.uint8))[3] == [round(50 + (k - 2) * 25) for k in range(5)]
    two = np.concatenate([staff(), staff()])
    assert len(V.skeleton(two, grand=True)[3]) == 10 and len(V.skeleton(two)[3]) == 5


def test_runs_and_components_against_loops():
    rng = np.random.default_rng(2)
    for _ in range(30):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.45
        seen, want = set(), []
        for start in zip(*np.nonzero(mask), strict=True):
            if start in seen:
                continue
            todo, piece = [start], {start}
            while todo:
                y, x = todo.pop()
                for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in piece:
                        piece.add(p)
                        todo.append(p)
            seen |= piece
            ys, xs = zip(*piece, strict=True)
            want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
        assert sorted(V.components(mask)) == sorted(want)


def test_normalise():
    out, tilt, bend = V.normalise(staff())
    assert (tilt, bend) == (0.0, 0.0) and (out == staff()).all()
    assert V.normalise(staff()[:10])[1:] == (0.0, 0.0) and V.normalise(np.full((20, 40), 255, np.uint8))[2] == 0.0
    curl = 12 * np.maximum(0, 1 - np.maximum(0, np.arange(600) - 20) / 150.0) ** 2
    bent = V.shift_columns(staff(), -curl)  # lines lie lower at the left
    flat, _, bend = V.normalise(bent)
    assert 6 <= bend <= 20
    drift = lambda img: np.ptp([(img[50:130, x] < 128).argmax() for x in range(40, 560, 20)])
    assert drift(bent) >= 7 and drift(flat) <= 3
    turned = rotate(staff(), 3.0)
    assert abs(skew(V.normalise(turned)[0])) < 1.0 and abs(V.normalise(turned)[1]) >= 2


def test_connectors():
    both = np.concatenate([staff(150), staff(150)])
    upper, lower = (20, 60 + 50), (20, 150 + 60)
    assert V.connector(both, upper, lower, 12) is None
    bar = both.copy()
    bar[60:260, 18:21] = 10
    assert V.connector(bar, upper, lower, 12) == 18
    dashed = both.copy()
    dashed[104:216, 10:13] = np.where(np.arange(112)[:, None] % 5 < 3, 10, 245)
    assert V.connector(dashed, upper, lower, 12) is not None
    dots = both.copy()
    dots[104:216:12, 10:13] = 10
    assert V.connector(dots, upper, lower, 12) is None
    assert V.connector(both, (20, 110), (25, 100), 12) == 20 and V.connector(both, (-500, 110), (-500, 210), 12) is None


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 300), (300, 7)):
        img = rng.integers(0, 256, shape).astype(np.uint8)
        assert (V.from_png(V.to_png(img)) == img).all()


def run_over(spark, folder, sink, **how):
    df = spark.range(60).repartition(14)
    df.write.parquet(f"{folder}/in")
    return R.Run(S.files(spark, f"{folder}/in", df.schema, 4), lambda b, i: sink(b, i) or b.write.mode("overwrite").parquet(f"{folder}/replies/batch={i}"), folder, wait=0.01, **how)


def rows_of(spark, folder):
    return sorted(r.id for r in spark.read.parquet(f"{folder}/replies").collect())


def test_lost_connections_are_tried_again(spark, tmp_path):
    tries = {}

    def lose(batch, number):
        tries[number] = tries.get(number, 0) + 1
        if tries[number] <= 2:
            raise ConnectionError("gone")

    run = run_over(spark, tmp_path, lose, retries=2)
    assert run.start().join() == "done" and set(tries.values()) == {3} and run.log.count("paused") == 2 * len(tries)
    assert rows_of(spark, tmp_path) == list(range(60))


def test_a_connection_that_stays_lost_ends_the_run(spark, tmp_path):
    def lose(batch, number):
        raise TimeoutError("gone")

    run = run_over(spark, tmp_path, lose, retries=2)
    with pytest.raises(StreamingQueryException):
        run.start().join()
    assert run.state == "failed" and run.log == ["running", "paused", "running", "paused", "running", "failed"]


def test_first_error_ends_the_run_and_the_batch_comes_again(spark, tmp_path):
    seen = []

    def check(batch, number):
        seen.append(number)
        if number == 1:
            raise ValueError("bad")

    run = run_over(spark, tmp_path, check)
    with pytest.raises(StreamingQueryException):
        run.start().join()
    assert run.state == "failed" and isinstance(run.error, ValueError) and seen == [0, 1] and run.start().state == "failed"
    before = rows_of(spark, tmp_path)
    again = R.Run(run.stream, lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/replies/batch={i}"), str(tmp_path))
    assert again.start().join() == "done" and 0 < len(before) < 60 and rows_of(spark, tmp_path) == list(range(60))


def test_pause_resume_stop(spark, tmp_path):
    run = run_over(spark, tmp_path, lambda b, i: None)
    run.pause()
    assert run.state == "idle"
    run.start()
    run.pause()
    assert run.state == "paused" and run.join() == "paused"
    assert run.resume().join() == "done" and rows_of(spark, tmp_path) == list(range(60))
    run.stop()
    assert run.state == "done"


def test_commands(spark):
    rng = random.Random(8)
    rows = [(w, i, rng.choice(["start", "stop", "pause", "resume", "scan", "start", "pause", "resume"] + ["shutdown"] * (i > 20))) for w in range(20) for i in range(30)]
    want = []
    for w in range(20):
        running = paused = False
        for _, i, cmd in (r for r in rows if r[0] == w):
            if cmd == "start" and not running:
                running, paused = True, False
            elif cmd == "stop":
                running = paused = False
            elif cmd in ("pause", "resume") and running:
                paused = cmd == "pause"
            want.append((w, i, "ended" if cmd == "shutdown" else "paused" if paused else "running" if running else "idle"))
            if cmd == "shutdown":
                break
    got = R.states(spark.createDataFrame(rows, "worker long, seq long, cmd string"))
    assert sorted((r.worker, r.seq, r.state) for r in got.collect()) == want


def test_single_crops(spark):
    asked = spark.createDataFrame([("b__page_1", "system_1"), ("b__page_1", "system_1"), ("b", "s"), ("b__page_2", "none"), ("b__page_2", "void"), (None, "x")], "page_id string, stub string")
    crops = spark.createDataFrame([("b", "system_1", False, b"raw"), ("b", "system_1", True, b"level"), ("b", "void", False, None)], "book string, stub string, deskewed boolean, data binary")
    read = Stage("r", "ask", "abc string, raw_kern string, model_used string", lambda b: pd.DataFrame({"ask": b["ask"], "abc": b["kind"] + [bytes(d).decode() for d in b["data"]], "raw_kern": None, "model_used": "m"}))
    got = sorted((r.page_id or "", r.stub, r.status, r.message, r.abc, r.kern) for r in C.transcribe_live(asked, crops, read).collect())
    ok = ("b__page_1", "system_1", "success", None, "systemlevel", "")
    assert got == sorted([ok, ok, ("b", "s", "error", "Invalid page_id: b", None, None), ("b__page_2", "none", "error", "Crop file not found: none", None, None), ("b__page_2", "void", "error", "Failed to read crop image", None, None), ("", "x", "error", "Invalid page_id: ", None, None)])
    gone = C.transcribe_live(asked.limit(1), crops, absent("recogniser", "ask", "abc string, raw_kern string, model_used string")).first()
    assert gone.status == "error" and "recogniser is not installed" in gone.message
