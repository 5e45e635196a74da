"""Queries over model servers, conversions, staff crops and the control of streams.

Where a step needs a server, a converter or an engraver, the query plugs in a plain function that
answers, fails or gives nothing by key: what is shown is the operator around it, not a model.
"""

from __future__ import annotations

import re
import time
import urllib.error
from hashlib import md5

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import convert as C
from ..operators import pixels as X
from ..operators import staves as V
from ..sources import client as L
from ..sources.stages import Stage
from ..streaming import control as R
from . import streams
from .registry import query, shared, table


@query("con_01", "SELECT 'http://s' || c_custkey AS url, c_custkey % 3 < 2 AS online, CASE c_custkey % 3 WHEN 0 THEN 'Server reachable (2 models available)' WHEN 1 THEN 'VLM server reachable (1 models available)' ELSE 'Connection error to http://s' || c_custkey || ': refused' END AS message, CASE c_custkey % 3 WHEN 0 THEN 'a' || c_custkey || ',b' WHEN 1 THEN 'c' || c_custkey ELSE '' END AS keys FROM customer")
def con_01(spark, sf_dir):
    """Servers asked by the native interface, then by the compatible one."""

    def fetch(url):
        key, native = int(re.search(r"s(\d+)", url)[1]), url.endswith(L.NATIVE)
        if key % 3 == 0 and native:
            return f'{{"models": [{{"key": "a{key}", "display_name": "A"}}, {{"key": "b"}}]}}'
        if key % 3 == 1:
            return "<html>" if native else f'{{"data": [{{"id": "c{key}"}}]}}'
        raise urllib.error.URLError("refused")

    urls = table(spark, sf_dir, "customer").select(F.concat(F.lit("http://s"), F.col("c_custkey").cast("string")).alias("url"))
    return L.probe(L.asking(fetch).apply(urls)).select("url", "online", "message", F.array_join("models.key", ",").alias("keys"))


# Lines of an event stream made from events; Spark and DuckDB read the same expression.
_DELTA = "CASE event_id % 7 WHEN 0 THEN 'a<think>b' WHEN 1 THEN 'c</think>d' WHEN 2 THEN 'x<think>y</think>z' WHEN 3 THEN 'p</think>q<think>r' ELSE 'w' || event_id || ' ' END"
_LINE = f"""CASE WHEN event_id % 97 = 0 THEN 'data: [DONE]' WHEN event_id % 11 = 0 THEN ': ping' WHEN event_id % 11 = 1 THEN 'data: {{oops'
WHEN event_id % 11 = 2 THEN 'data: {{"choices":[{{"delta":{{"reasoning_content":"r"}}}}]}}' ELSE 'data: {{"choices":[{{"delta":{{"content":"' || {_DELTA} || '"}}}}]}}' END"""


@query(
    "con_02",
    f"""WITH e AS (SELECT user_id, event_id, {_DELTA} AS d, event_id % 11 > 2 AS says, max(event_id % 97 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS ended FROM events),
    c AS (SELECT *, d LIKE '%<think>%' AS o, split_part(d, '<think>', 1) AS h FROM e WHERE says AND NOT ended),
    t AS (SELECT *, last_value(CASE WHEN h LIKE '%</think>%' THEN 0 WHEN o THEN 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
    v AS (SELECT user_id, event_id, CASE WHEN NOT o AND coalesce(before, 0) = 0 THEN d WHEN h LIKE '%</think>%' THEN substr(h, strpos(h, '</think>') + 8) ELSE '' END AS s FROM t)
    SELECT user_id AS reply, string_agg(s, '' ORDER BY event_id) AS text FROM v WHERE s <> '' GROUP BY user_id""",
)
def con_02(spark, sf_dir):
    """The visible text of event streams."""
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("reply"), F.col("event_id").alias("seq"), F.expr(_LINE).alias("line"))
    shown = L.visible(L.deltas(lines))
    chunks = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return shown.groupBy("reply").agg(F.array_join(F.transform(chunks, lambda c: c["delta"]), "").alias("text"))


def _walk(gap: float) -> str:
    """SQL of the rows that a reporter writes: from s(k, tm, done), each to the next one that is gap behind it."""
    return f"""n AS MATERIALIZED (SELECT k, tm, done, first_value(tm) OVER later AS tm2, first_value(done) OVER later AS done2 FROM s WINDOW later AS (PARTITION BY k ORDER BY tm RANGE BETWEEN {gap}::DOUBLE FOLLOWING AND UNBOUNDED FOLLOWING)),
    w AS (SELECT k, tm, done, NULL::DOUBLE AS took, NULL::BIGINT AS got FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tm, done) AS i FROM s) WHERE i = 1
      UNION ALL SELECT n.k, n.tm2, n.done2, n.tm2 - n.tm, (n.done2 - n.done)::BIGINT FROM n JOIN w ON n.k = w.k AND n.tm = w.tm AND n.done = w.done WHERE n.tm2 IS NOT NULL)"""


_DAYS = "epoch_us(ts) / 1e6::DOUBLE / 86400 AS tm"


@query(
    "con_04",
    f"""WITH RECURSIVE s AS (SELECT user_id AS k, {_DAYS}, sum((event_id % 1000 + 1) * 10000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM events), {_walk(0.5)},
    r AS (SELECT k, done, got / 1048576::DOUBLE / took AS speed FROM w WHERE took IS NOT NULL)
    SELECT k AS file, count(*)::BIGINT AS reports, round(sum(speed), 6)::DOUBLE AS speeds, round(sum(greatest(1000000000 - done, 0) / (speed * 1048576::DOUBLE)), 4)::DOUBLE AS etas FROM r GROUP BY k""",
)
def con_04(spark, sf_dir):
    """Rates of transfers at reports half a unit apart, and what is left."""
    from pyspark.sql import Window

    seen = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) / 86400
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), at.alias("at"), F.sum((F.col("event_id") % 1000 + 1) * 10000).over(seen).alias("done"), F.lit(10**9).alias("total"))
    return L.rates(e).groupBy("file").agg(F.count("*").alias("reports"), F.round(F.sum("speed"), 6).alias("speeds"), F.round(F.sum("eta"), 4).alias("etas"))


@query("stm_08", f"WITH RECURSIVE s AS (SELECT user_id AS k, {_DAYS}, event_id AS done FROM events), {_walk(0.12)}, p AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY tm, done) - 1) // 50 AS poll FROM w) SELECT k AS worker, poll::BIGINT AS poll, count(*)::BIGINT AS n FROM p GROUP BY ALL")
def stm_08(spark, sf_dir):
    """Heartbeats no closer than a gap, taken fifty to a poll."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) / 86400
    beats = L.spaced(table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), at.alias("seq"), "event_id"), "worker", "seq", 0.12)
    return beats.withColumn("poll", L.drained_by()).groupBy("worker", "poll").agg(F.count("*").alias("n"))


_TYPES = "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM events"


def _run(spark, sf_dir, sink):
    """A run over all events in two batches or more, each written under its number by a sink that may break."""
    stream, folder = streams._stream(spark, table(spark, sf_dir, "events").select("event_id", "event_type", "value").repartition(8))
    out = f"{folder}/replies"

    def write(batch, number):
        sink(batch, number)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return R.Run(stream, write, folder, wait=0.05), out, folder


def _by_type(spark, out):
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("api_03", f"{_TYPES} GROUP BY ALL")
def api_03(spark, sf_dir):
    """A run started, paused after its first batch, gone on with, and stopped when it was done: each row once."""
    run, out, _ = _run(spark, sf_dir, lambda batch, number: None)
    run.start()
    while run.done == 0 and run._query.isActive:
        time.sleep(0.05)
    run.pause()
    run.resume().join()
    run.stop()
    return _by_type(spark, out)


@query("stm_07", f"{_TYPES} GROUP BY ALL")
def stm_07(spark, sf_dir):
    """Every batch loses its connection once; the run pauses and does the same batch again."""
    lost = set()

    def lose(batch, number):
        if number not in lost:
            lost.add(number)
            raise ConnectionError("server is gone")

    run, out, _ = _run(spark, sf_dir, lose)
    run.start().join()
    return _by_type(spark, out)


@query("stm_10", f"{_TYPES} WHERE event_id >= 0 AND event_id NOT IN (SELECT max(event_id) FROM events) GROUP BY ALL")
def stm_10(spark, sf_dir):
    """The first error ends a run; a second one from the same marks goes on at the batch that failed, without the bad row."""
    bad = table(spark, sf_dir, "events").agg(F.max("event_id").alias("bad")).first()["bad"]

    def check(batch, number):
        if not batch.where(F.col("event_id") == bad).isEmpty():
            raise ValueError("bad row")

    run, out, folder = _run(spark, sf_dir, check)
    try:
        run.start().join()
    except StreamingQueryException:
        assert run.state == "failed"
    again = R.Run(run.stream, lambda batch, number: batch.where(F.col("event_id") != bad).write.mode("overwrite").parquet(f"{out}/batch={number}"), folder)
    again.start().join()
    return _by_type(spark, out)


_CMD = "CASE WHEN event_id % 501 = 500 THEN 'shutdown' ELSE ['start', 'pause', 'scan', 'resume', 'pause', 'start', 'update_config', 'stop', 'resume'][event_id % 9 + 1] END"


@query(
    "api_11",
    f"""WITH c AS (SELECT user_id AS worker, event_id AS seq, {_CMD} AS cmd FROM events),
    l AS (SELECT * FROM c ANTI JOIN (SELECT worker, min(seq) AS last FROM c WHERE cmd = 'shutdown' GROUP BY worker) e ON c.worker = e.worker AND c.seq > e.last),
    a AS (SELECT *, coalesce((SELECT max(x.seq) FROM l x WHERE x.worker = l.worker AND x.seq < l.seq AND x.cmd = 'start') > coalesce((SELECT max(x.seq) FROM l x WHERE x.worker = l.worker AND x.seq < l.seq AND x.cmd = 'stop'), -1), false) AS alive FROM l),
    t AS (SELECT *, CASE WHEN cmd = 'shutdown' THEN 'ended' WHEN cmd = 'stop' THEN 'idle' WHEN cmd = 'start' AND NOT alive THEN 'running' WHEN cmd = 'pause' AND alive THEN 'paused' WHEN cmd = 'resume' AND alive THEN 'running' END AS turn FROM a)
    SELECT worker, seq, cmd, coalesce((SELECT max_by(x.turn, x.seq) FROM t x WHERE x.worker = t.worker AND x.seq <= t.seq AND x.turn IS NOT NULL), 'idle') AS state FROM t""",
)
def api_11(spark, sf_dir):
    """What a worker does behind each command."""
    cmd = F.expr(_CMD.replace("['", "array('").replace("'][event_id % 9 + 1]", "')[int(event_id % 9)]"))
    return R.states(table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), cmd.alias("cmd")))


def _answers(column: str, fn, key: str = "stub") -> Stage:
    """A stage of a plain function of a row; None is no output."""

    def run(rows):
        got = [(r[key], fn(r)) for r in rows.to_dict("records")]
        return pd.DataFrame([g for g in got if g[1] is not None], columns=[key, column])

    return Stage(column, key, f"{column} string", run)


_NAMED = "CASE WHEN p_size % 3 = 0 THEN 'T:' || p_name || chr(10) ELSE '' END"


@query(
    "not_06",
    f"""SELECT p_partkey::VARCHAR AS stub, CASE p_partkey % 4 WHEN 0 THEN 'X:1' || chr(10) || {_NAMED} || 'L:1/4' || chr(10) || 'M:none' || chr(10) || 'I:linebreak $' || chr(10) || 'K:C' || chr(10) || 'V:1 treble' || chr(10) || 'V:1' || chr(10) || array_to_string(list_transform(range(0, least(p_size, 32)), lambda i: ['C', 'D', 'z', 'E'][i % 4 + 1]), ' ') || ' |'
    WHEN 1 THEN 'X:1' || chr(10) || {_NAMED} || 'K:C' || chr(10) || 'second' WHEN 2 THEN 'X:1' || chr(10) || {_NAMED} || 'M:4/4' || chr(10) || 'L:1/4' || chr(10) || 'K:C' || chr(10) || 'z4 |'
    ELSE 'X:1' || chr(10) || CASE WHEN p_size % 3 = 0 THEN 'T:' || p_name ELSE 'T:other' END || chr(10) || 'K:C' || chr(10) || 'first' END AS abc,
    CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END::INTEGER AS attempt FROM part""",
)
def not_06(spark, sf_dir):
    """Scores through a first and a second converter, then from their events."""
    first = _answers("abc", lambda r: {2: "", 3: "X:1\nT:other\nC:Music21\nK:C\nfirst"}.get(int(r["stub"]) % 4))
    second = _answers("abc", lambda r: "X:1\nT:Music21 Fragment\nK:C\nsecond" if int(r["stub"]) % 4 == 1 else None)
    events = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.get(F.array(*map(F.lit, "CDzE")), i % 4))
    rows = table(spark, sf_dir, "part").where("p_size > 0").select(F.col("p_partkey").cast("string").alias("stub"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("title"), events.alias("events"))
    return C.to_abc(rows, (first, second))


_OUTER = "class=\"outer\" note=\"' || CASE WHEN p_partkey % 2 = 0 THEN repeat('x', 200) ELSE '' END || '\">"
_BOX = "viewBox=\"0 0 ' || p_size || ' 9\""


@query(
    "not_05",
    f"""SELECT p_partkey::VARCHAR AS stub, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_size % 6 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN '<svg {_OUTER}<g/></svg>'
    ELSE '<svg ' || CASE WHEN p_partkey % 2 = 0 THEN '{_BOX} ' ELSE '' END || '{_OUTER}<g class="definition-scale" {_BOX}><g/></g></svg>' END AS svg FROM part""",
)
def not_05(spark, sf_dir):
    """Engraved scores: none for failed or uneven texts, one root otherwise."""

    def draw(r):
        key, size, _ = r["kern"].split(" ", 2)
        note = "x" * 200 if int(key) % 2 == 0 else ""
        inner = "<g/>" if int(key) % 3 == 0 else f'<svg class="definition-scale" viewBox="0 0 {size} 9"><g/></svg>'
        return None if int(key) % 7 == 0 else f'<svg class="outer" note="{note}">{inner}</svg>'

    kern = F.expr("CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN '% [OMR Conversion Error]' ELSE p_partkey || ' ' || p_size || ' x' END")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stub"), kern.alias("kern"), (F.col("p_size") % 6 != 0).alias("valid"))
    return C.engrave(rows, _answers("svg", draw))


@query("not_08", "SELECT p_partkey::VARCHAR AS stub, CASE WHEN p_partkey % 2 = 1 THEN 'stored' WHEN p_size % 5 = 0 OR p_partkey % 3 = 0 THEN '' ELSE '**kern X:1 ' || p_name END AS kern, p_partkey % 2 = 0 AND p_size % 5 <> 0 AND p_partkey % 3 <> 0 AS made FROM part")
def not_08(spark, sf_dir):
    """Missing kern texts from their scores."""
    abc = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit(" X:1 "), "p_name")).otherwise(F.when(F.col("p_size") % 2 == 0, " "))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stub"), abc.alias("abc"), F.when(F.col("p_partkey") % 2 == 1, " stored\n").alias("kern"))
    stage = _answers("kern", lambda r: f"**kern {r['abc']}" if int(r["stub"]) % 3 else None)
    return C.backfill(rows, stage).select("stub", "kern", "made")


@query(
    "api_07",
    """SELECT CASE WHEN p_partkey % 5 = 0 THEN 'b' || p_partkey ELSE 'b' || p_partkey || '__page_1' END AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 'grand_staff_' ELSE 'staff_' END || p_partkey AS stub,
    CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 'error' ELSE 'success' END AS status,
    CASE WHEN p_partkey % 5 = 0 THEN 'Invalid page_id: b' || p_partkey WHEN p_partkey % 7 = 0 THEN 'Crop file not found: ' || CASE WHEN p_partkey % 2 = 0 THEN 'grand_staff_' ELSE 'staff_' END || p_partkey WHEN p_partkey % 11 = 0 THEN 'Failed to read crop image' END AS message,
    CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'grand_staff' ELSE 'staff' END || CASE WHEN p_partkey % 3 = 0 THEN ' deskewed' ELSE ' raw' END END AS abc FROM part""",
)
def api_07(spark, sf_dir):
    """Single crops read on demand: the levelled picture before the raw one, and what is said where there is none."""
    p, stub = table(spark, sf_dir, "part"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'grand_staff_' ELSE 'staff_' END || p_partkey").alias("stub")
    asked = p.select(F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'b' || p_partkey ELSE 'b' || p_partkey || '__page_1' END").alias("page_id"), stub)
    crops = p.where("p_partkey % 7 <> 0").select(F.expr("'b' || p_partkey").alias("book"), stub, "p_partkey")
    both = crops.where("p_partkey % 3 = 0").withColumn("deskewed", F.lit(True)).unionByName(crops.withColumn("deskewed", F.lit(False)))
    data = F.when(F.col("p_partkey") % 11 != 0, F.when(F.col("deskewed"), " deskewed").otherwise(" raw").cast("binary"))
    read = Stage("read", "ask", "abc string, raw_kern string, model_used string", lambda b: pd.DataFrame({"ask": b["ask"], "abc": [k + bytes(d).decode() for k, d in zip(b["kind"], b["data"], strict=True)], "raw_kern": "", "model_used": "none"}))
    return C.transcribe_live(asked, both.select("book", "stub", "deskewed", data.alias("data")), read).select("page_id", "stub", "status", "message", "abc")


@query("snk_01")
def snk_01(spark, sf_dir):
    """Pages written as PNG and read back: their size from the header, their ink from the picture."""
    folder = f"{shared(spark)}/png"
    streams._of_pages(spark, sf_dir, lambda i: (V.to_png(i),), "png binary").write.parquet(folder)
    ink = X.over_images(lambda file: int((V.from_png(file.tobytes()) < 128).sum()), "long")  # a file is one row of bytes
    size = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
    return spark.read.parquet(folder).select("p_partkey", size(17).alias("width"), size(21).alias("height"), ink(F.lit(1), F.length("png"), F.col("png")).alias("ink"))


@query("img_06")
def img_06(spark, sf_dir):
    """Level crops: their height, tilt and bend."""

    def level(img):
        out, tilt, most = V.normalise(img)
        return out.shape[0], tilt, most, md5(out.tobytes()).hexdigest()

    return streams._of_pages(spark, sf_dir, level, "height int, tilt double, bend double, md5 string")


@query("img_07")
def img_07(spark, sf_dir):
    """The staff lines of a crop alone."""

    def lines(img):
        mask, thick, space, rows = V.skeleton(img)
        return thick, space, rows, int(mask.sum())

    return streams._of_pages(spark, sf_dir, lines, "thick int, space int, lines array<int>, ink long")


@query("img_13")
def img_13(spark, sf_dir):
    """Where the first two staves of a page are joined: some pages have a bar at their left, drawn here by key."""

    def joined(img):
        gap = round(X.spacing(img))
        low, top = 30 + 4 * gap + 2, 30 + 12 * gap
        if top > 279:
            return (None,)
        drawn = img.copy()
        if gap % 2 == 0:
            drawn[30 : top + 4 * gap, 28:31] = 20
        return (V.connector(drawn, (30, low), (30, top), gap),)

    return streams._of_pages(spark, sf_dir, joined, "x int")
