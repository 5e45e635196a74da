"""Notation queries. Kern documents are made of events: one document for each user, in order of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kern as K
from ..functions.rounding import round_even
from ..operators import notation as N
from .registry import query, table

TOKEN = "CASE event_type WHEN 'click' THEN '4c' WHEN 'view' THEN '8d' WHEN 'purchase' THEN '4.e' WHEN 'signup' THEN '4r' ELSE '=' END"
_T = f"t AS (SELECT user_id AS doc, event_id, {TOKEN} AS token FROM events)"
_BEATS = "CASE token WHEN '4c' THEN 1.0::DOUBLE WHEN '8d' THEN 0.5::DOUBLE WHEN '4.e' THEN 1.5::DOUBLE WHEN '4r' THEN 1.0::DOUBLE END"
_M = f"""{_T}, b AS (SELECT *, sum((token = '=')::INT) OVER (PARTITION BY doc ORDER BY event_id) AS bars FROM t),
d AS (SELECT doc, event_id, bars, token, {_BEATS} AS beats FROM b WHERE token <> '='),
m AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY bars) AS measure, count(*) OVER (PARTITION BY doc) AS last, beats FROM (SELECT doc, bars, round_even(sum(beats), 3) AS beats FROM d GROUP BY ALL))"""


def kern_docs(spark, sf_dir) -> DataFrame:
    """(doc, raw_kern, crop_width)."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.struct("event_id", F.expr(TOKEN).alias("token")).alias("e"))
    body = events.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["token"]), "\n").alias("body"))
    return body.select("doc", F.concat(F.lit("**kern\n*clefG2\n*M4/4\n"), "body", F.lit("\n*-")).alias("raw_kern"), F.lit(700).alias("crop_width"))


def lines(spark, sf_dir) -> DataFrame:
    return N.kern_lines(kern_docs(spark, sf_dir))


_REPORT = f"""WITH {_M},
c AS (SELECT doc, count_if(token = '4r') AS rests, count_if(token <> '4r') AS notes FROM d GROUP BY doc),
p AS (SELECT doc, event_id, regexp_replace(token, '\\d+\\.*', '', 'g') AS p FROM d),
i AS (SELECT *, sum((p IS DISTINCT FROM prev)::INT) OVER (PARTITION BY doc ORDER BY event_id) AS island FROM (SELECT *, lag(p) OVER (PARTITION BY doc ORDER BY event_id) AS prev FROM p)),
r AS (SELECT doc, max(n) AS run, sum(n) AS tokens FROM (SELECT doc, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY doc),
o AS (SELECT doc, count(*) AS measures, count_if(abs(beats - 4) > 0.3 AND NOT ((measure = 1 OR measure = last) AND beats < 4)) AS off FROM m GROUP BY doc),
x AS (SELECT u.doc, coalesce(notes, 0) AS notes, coalesce(rests, 0) AS rests, coalesce(measures, 0) AS measures, coalesce(off, 0) AS off, coalesce(run, 0) AS run, coalesce(tokens, 0) AS tokens
  FROM (SELECT DISTINCT doc FROM t) u LEFT JOIN c USING (doc) LEFT JOIN o USING (doc) LEFT JOIN r USING (doc)),
s AS (SELECT *, least(0.35::DOUBLE, 0.1::DOUBLE * off) + CASE WHEN notes = 0 AND rests = 0 THEN 0.85::DOUBLE WHEN notes = 0 THEN 0.4::DOUBLE ELSE 0::DOUBLE END + CASE WHEN notes = 0 THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN tokens >= 8 AND run >= 8 THEN 0.35::DOUBLE ELSE 0 END AS penalty FROM x)
"""


@query(
    "not_07",
    _REPORT
    + """SELECT doc, round(greatest(0, least(1, 1 - penalty)), 6)::DOUBLE AS score, round(greatest(0, least(1, 1 - penalty)), 6) >= 0.65 AND notes > 0 AS is_valid, measures::BIGINT AS measure_count,
notes::BIGINT AS note_count, rests::BIGINT AS rest_count, off::BIGINT AS imbalanced, run::BIGINT AS longest_run, '4/4' AS signature, round(notes / 700.0::DOUBLE * 100, 6)::DOUBLE AS density FROM s""",
)
def not_07(spark, sf_dir):
    """Notation quality report: the flagship."""
    return N.validate(kern_docs(spark, sf_dir)).drop("anomalies", "clefs")


@query("agg_07", _REPORT + "SELECT count(*)::BIGINT AS total, count_if(round(greatest(0, least(1, 1 - penalty)), 6) >= 0.65 AND notes > 0)::BIGINT AS passed, count_if(penalty > 0)::BIGINT AS flagged, round(avg(round(greatest(0, least(1, 1 - penalty)), 6)) * 100, 4)::DOUBLE AS avg_pct FROM s")
def agg_07(spark, sf_dir):
    """Report KPIs."""
    r = N.validate(kern_docs(spark, sf_dir))
    return r.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("passed"), F.count_if(F.size("anomalies") > 0).alias("flagged"), F.round(F.avg("score") * 100, 4).alias("avg_pct"))


@query("flt_12", _REPORT + "SELECT doc, s1 >= 0.65 AND notes > 0 AND penalty = 0 AS clean, CASE WHEN round_even(s1 * 100, 0) >= 85 THEN 'good' WHEN round_even(s1 * 100, 0) >= 65 THEN 'fair' ELSE 'poor' END AS badge FROM (SELECT *, round(greatest(0, least(1, 1 - penalty)), 6) AS s1 FROM s)")
def flt_12(spark, sf_dir):
    """Report row class."""
    r = N.validate(kern_docs(spark, sf_dir))
    pct = round_even(F.col("score") * 100, 0)
    return r.select("doc", (F.col("is_valid") & (F.size("anomalies") == 0)).alias("clean"), F.when(pct >= 85, "good").when(pct >= 65, "fair").otherwise("poor").alias("badge"))


@query("win_23", f"WITH {_M} SELECT doc, bars::BIGINT AS bars, count(*)::BIGINT AS n FROM d GROUP BY ALL")
def win_23(spark, sf_dir):
    """Measure id as a running count of barlines."""
    return lines(spark, sf_dir).where("kind = 'data'").groupBy("doc", F.col("bars").cast("long").alias("bars")).agg(F.count("*").alias("n"))


@query("agg_16", f"WITH {_M} SELECT doc, bars::BIGINT AS bars, 0 AS spine, round(sum(beats), 6)::DOUBLE AS beats FROM d GROUP BY ALL")
def agg_16(spark, sf_dir):
    """Sum of durations by measure and spine."""
    return N.voices(lines(spark, sf_dir)).select("doc", F.col("bars").cast("long").alias("bars"), F.col("spine").cast("int").alias("spine"), F.round("beats", 6).alias("beats"))


@query("agg_17", f"WITH {_M} SELECT doc, bars::BIGINT AS bars, 1 AS spines FROM d GROUP BY ALL")
def agg_17(spark, sf_dir):
    """Most spines of a measure."""
    return lines(spark, sf_dir).where("kind = 'data'").groupBy("doc", F.col("bars").cast("long").alias("bars")).agg(F.max(F.size(F.split("line", "\t"))).alias("spines"))


@query("win_24", f"WITH {_M} SELECT doc, measure::BIGINT AS measure, (measure = 1 OR measure = last) AS boundary, (abs(beats - 4) > 0.3 AND NOT ((measure = 1 OR measure = last) AND beats < 4)) AS imbalanced FROM m")
def win_24(spark, sf_dir):
    """First and last measures are exempt when short."""
    m = N.measures(N.voices(lines(spark, sf_dir)))
    edge = (F.col("measure") == 1) | (F.col("measure") == F.col("last"))
    return m.select("doc", F.col("measure").cast("long").alias("measure"), edge.alias("boundary"), ((F.abs(F.col("beats") - 4) > 0.3) & ~(edge & (F.col("beats") < 4))).alias("imbalanced"))


@query("agg_12", f"WITH {_M}, q AS (SELECT doc, round_even(beats, 1) AS b, count(*) AS n, min(measure) AS seen FROM m WHERE beats > 0 GROUP BY ALL) SELECT doc, b::DOUBLE AS common, n::BIGINT AS times FROM q QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) = 1")
def agg_12(spark, sf_dir):
    """Most frequent duration, the first seen of equals."""
    return N.common_beats(N.measures(N.voices(lines(spark, sf_dir)))).select("doc", "common", "times")


@query("win_12", _REPORT + "SELECT doc, run::BIGINT AS run, (tokens >= 8 AND run >= 8) AS looped FROM s WHERE tokens > 0")
def win_12(spark, sf_dir):
    """Longest run of equal pitches."""
    return N.longest_run(lines(spark, sf_dir)).select("doc", F.col("run").cast("long").alias("run"), ((F.col("tokens") >= 8) & (F.col("run") >= 8)).alias("looped"))


_SIG = f"""WITH {_M}, g AS (SELECT doc, bars, list_sort(list(DISTINCT regexp_replace(token, '[^a-gr]', '', 'g'))) AS sig FROM d GROUP BY ALL),
s AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY bars) AS measure, sig FROM g),
j AS (SELECT a.doc, a.measure, b.measure AS other, len(list_intersect(a.sig, b.sig)) / len(list_distinct(list_concat(a.sig, b.sig)))::DOUBLE AS sim FROM s a JOIN s b ON a.doc = b.doc AND (b.measure = 1 OR b.measure BETWEEN a.measure - 4 AND a.measure - 1) AND b.measure < a.measure)"""


@query("set_03", _SIG + " SELECT doc, measure::BIGINT AS measure, round(sim, 9)::DOUBLE AS sim FROM j WHERE other = measure - 1")
def set_03(spark, sf_dir):
    """Jaccard similarity of neighbouring measures' pitch sets."""
    s = N.signatures(lines(spark, sf_dir))
    before = F.lag("sig").over(Window.partitionBy("doc").orderBy("measure"))
    return s.withColumn("before", before).where("before is not null").select("doc", F.col("measure").cast("long").alias("measure"), F.round(K.jaccard(F.col("sig"), F.col("before")), 9).alias("sim"))


@query("win_14", _SIG + " SELECT doc, min(measure)::BIGINT AS wraps_at FROM j WHERE other = 1 AND measure >= 3 AND sim >= 0.55 GROUP BY doc")
def win_14(spark, sf_dir):
    """First measure from the third on that is like the first one."""
    s = N.signatures(lines(spark, sf_dir))
    first = F.first("sig").over(Window.partitionBy("doc").orderBy("measure"))
    like = s.withColumn("first", first).where((F.col("measure") >= 3) & (K.jaccard(F.col("sig"), F.col("first")) >= 0.55))
    return like.groupBy("doc").agg(F.min("measure").cast("long").alias("wraps_at"))


@query(
    "win_13",
    _SIG
    + """ , k AS (SELECT doc, measure, measure - other AS k, sim FROM j WHERE measure - other BETWEEN 1 AND 4),
c AS (SELECT doc, k, measure, avg(sim) OVER (PARTITION BY doc, k ORDER BY measure ROWS BETWEEN k - 1 PRECEDING AND CURRENT ROW) AS a FROM k)
SELECT doc, k::INTEGER AS k, min(measure - k)::BIGINT AS cutoff FROM c WHERE round(a, 9) >= 0.55 AND measure >= CASE WHEN k = 1 THEN 3 ELSE 2 * k END GROUP BY ALL""",
)
def win_13(spark, sf_dir):
    """Cycles of 1 to 4 measures: where the mean similarity to the cycle before reaches 0.55 first, for each length."""
    s = N.signatures(lines(spark, sf_dir))
    order = Window.partitionBy("doc").orderBy("measure")
    found = []
    for k in (1, 2, 3, 4):
        sim = s.withColumn("before", F.lag("sig", k).over(order)).where("before is not null").withColumn("sim", K.jaccard(F.col("sig"), F.col("before")))
        mean = F.round(F.avg("sim").over(order.rowsBetween(1 - k, 0)), 9)
        hit = sim.withColumn("mean", mean).where((F.col("mean") >= 0.55) & (F.col("measure") >= (3 if k == 1 else 2 * k)))
        found.append(hit.groupBy("doc").agg(F.lit(k).alias("k"), (F.min("measure") - k).cast("long").alias("cutoff")))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("mth_01", f"WITH {_T} SELECT DISTINCT token, {_BEATS} AS beats FROM t")
def mth_01(spark, sf_dir):
    """Duration of a token in quarter beats."""
    token = table(spark, sf_dir, "events").select(F.expr(TOKEN).alias("token")).distinct()
    return token.select("token", K.beats(F.col("token")).alias("beats"))


@query("mth_02", "SELECT p_partkey, (p_size % 7) || '/' || (p_size % 4) AS sig, CASE WHEN p_size % 4 <> 0 THEN (p_size % 7)::DOUBLE / (p_size % 4)::DOUBLE * 4 END AS beats FROM part")
def mth_02(spark, sf_dir):
    """Expected beats of a time signature."""
    sig = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_size % 7, '/', p_size % 4) AS sig")
    return sig.select("p_partkey", "sig", K.expected_beats(F.col("sig")).alias("beats"))


@query("mth_03", "SELECT p_partkey, round(p_size::DOUBLE / (p_partkey % 500 + 1)::DOUBLE * 100, 6)::DOUBLE AS density FROM part")
def mth_03(spark, sf_dir):
    """Notes for each hundred pixels."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_size").cast("double") / (F.col("p_partkey") % 500 + 1) * 100, 6).alias("density"))


@query("mth_08", "SELECT l_orderkey, l_linenumber, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.05 - l_discount * 15))::DOUBLE AS score FROM lineitem")
def mth_08(spark, sf_dir):
    """Scores are held in 0..1."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.05 - F.col("l_discount") * 15)).alias("score"))


@query("mth_09", f"SELECT event_id, list_min(list_transform(range(1, 10), lambda i: {{'d': abs(value / 100 - x[i]), 'i': i, 's': x[i]}})).s::DOUBLE AS beats FROM (SELECT *, {list(K.STANDARD_BEATS)}::DOUBLE[] AS x FROM events)")
def mth_09(spark, sf_dir):
    """Nearest standard duration."""
    return table(spark, sf_dir, "events").select("event_id", K.nearest_standard(F.col("value") / 100).alias("beats"))


@query("str_16", f"WITH {_T} SELECT DISTINCT token, regexp_replace(token, '\\d+\\.*', '', 'g') AS pitch, array_to_string(list_sort(regexp_extract_all(lower(token), '[a-gr]')), '') AS letters FROM t")
def str_16(spark, sf_dir):
    """Pitch and sorted letters of a token."""
    token = table(spark, sf_dir, "events").select(F.expr(TOKEN).alias("token")).distinct()
    return token.select("token", K.pitch(F.col("token")).alias("pitch"), K.letters(F.col("token")).alias("letters"))


@query("top_01", f"WITH {_M}, a AS (SELECT doc, measure FROM m WHERE abs(beats - 4) > 0.3 AND NOT ((measure = 1 OR measure = last) AND beats < 4)) SELECT doc, array_to_string(list(measure ORDER BY measure)[1:3], ',') AS first3 FROM a GROUP BY doc")
def top_01(spark, sf_dir):
    """The first three anomalies of a document."""
    m = win_24(spark, sf_dir).where("imbalanced")
    return m.groupBy("doc").agg(F.array_join(F.slice(F.array_sort(F.collect_list("measure")), 1, 3), ",").alias("first3"))


@query("top_04", f"WITH {_M}, e AS (SELECT doc, event_id, CASE token WHEN '4r' THEN 'z' ELSE upper(regexp_replace(token, '[^a-g]', '', 'g')) END AS name, row_number() OVER (PARTITION BY doc ORDER BY event_id) AS n FROM d) SELECT doc, string_agg(name, ' ' ORDER BY n) AS body FROM e WHERE n <= 32 GROUP BY doc")
def top_04(spark, sf_dir):
    """The body of a stand-in score: the first 32 notes and rests."""
    first = lines(spark, sf_dir).where("kind = 'data'").select("doc", "pos", F.split("line", "\t")[0].alias("token"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).where("n <= 32")
    name = F.when(F.col("token").contains("r"), "z").otherwise(F.upper(F.regexp_replace("token", "[^a-g]", "")))
    return first.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", name.alias("s")))), lambda e: e["s"]), " ").alias("body"))


@query("str_12", "SELECT conv_id, turn, replace(replace(replace(replace(x, '<s>', ' '), '</s>', ''), '<t>', chr(9)), '<b>', chr(10)) AS decoded FROM (SELECT conv_id, turn, replace(coalesce(text, ''), ' ', '<s>') || '</s><t>x<b>' AS x FROM conversations)")
def str_12(spark, sf_dir):
    """Control tokens of the recogniser's output."""
    x = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("<s>")), F.lit("</s><t>x<b>"))
    for mark, plain in (("<s>", " "), ("</s>", ""), ("<t>", "\t"), ("<b>", "\n")):
        x = F.replace(x, F.lit(mark), F.lit(plain))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", x.alias("decoded"))


@query("not_01", "SELECT c_custkey, c_custkey % 5 <> 3 AS valid FROM customer")
def not_01(spark, sf_dir):
    """Column consistency of kern texts with splits and merges."""
    cases = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in (["**kern", "4c", "*-"], ["**kern", "*^", "4c\t4e", "*v\t*v", "4d", "*-"], ["**kern\t**kern", "4c\t4d", "*\t*^", "4c\t4d\t4e", "*-\t*-\t*-"], ["**kern", "4c\t4d", "*-"], ["!! x", "**kern", "*^", "*^\t*", "4c\t4d\t4e", "*v\t*v\t*v", "4c"]))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", K.spines_valid(cases).alias("valid"))


# Documents of one or two voices, on which every rule of the report holds somewhere; Spark and DuckDB read the same expressions.
_VOICE = f"CASE WHEN user_id % 7 = 1 OR user_id % 7 = 2 AND event_id % 50 <> 0 THEN '=' WHEN user_id % 7 = 0 AND event_type IN ('click', 'view', 'purchase') THEN '4r' ELSE {TOKEN} END"
_SECOND = "CASE WHEN a = '=' THEN '=' WHEN doc % 3 = 1 THEN a WHEN event_id % 5 = 0 THEN '2d' ELSE '4c' END"
_WIDTH = "CASE doc % 6 WHEN 0 THEN 200 WHEN 1 THEN 251 WHEN 2 THEN 700 WHEN 3 THEN 900 WHEN 4 THEN 0 END"
_METRE = "CASE doc % 4 WHEN 1 THEN '3/4' WHEN 0 THEN NULL ELSE '4/4' END"
_CLEF = "CASE WHEN doc % 5 = 0 THEN '*clefTAB' ELSE '*clefG2' END"
_LENGTHS = "CASE {} WHEN '8d' THEN 0.5::DOUBLE WHEN '4.e' THEN 1.5::DOUBLE WHEN '2d' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"


def voice_docs(spark, sf_dir) -> DataFrame:
    """(doc, raw_kern, crop_width): one document a user, some with uneven columns, tablature, without a metre, without notes, or failed."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "event_id", F.expr(_VOICE).alias("a"))
    e = e.withColumn("line", F.when(F.col("doc") % 3 == 0, F.col("a")).otherwise(F.concat("a", F.lit("\t"), F.expr(_SECOND))))
    body = e.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("body"))
    wide = lambda c: F.when(F.col("doc") % 3 == 0, c).otherwise(F.concat(c, F.lit("\t"), c))
    metre = F.expr(_METRE)
    head = F.concat_ws("\n", wide(F.lit("**kern")), wide(F.expr(_CLEF)), F.when(metre.isNotNull(), wide(F.concat(F.lit("*M"), metre))))
    text = F.concat_ws("\n", head, "body", F.when(F.col("doc") % 11 == 3, "*\t*\t*\t*"), wide(F.lit("*-")))
    return body.select("doc", F.when(F.col("doc") % 13 == 5, "% [OMR Batch Error] x").otherwise(text).alias("raw_kern"), F.expr(_WIDTH).alias("crop_width"))


@query(
    "not_07_voices",
    f"""WITH t AS (SELECT *, {_SECOND} AS b, sum((a = '=')::INT) OVER (PARTITION BY doc ORDER BY event_id) AS bars FROM (SELECT user_id AS doc, event_id, {_VOICE} AS a FROM events)),
    d AS (SELECT *, {_LENGTHS.format("a")} AS la, {_LENGTHS.format("b")} AS lb, right(a, 1) AS p FROM t WHERE a <> '='),
    m AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY bars) AS measure, count(*) OVER (PARTITION BY doc) AS last, beats, doc % 3 > 0 AND abs(beats - other) > 0.35 AS desync
      FROM (SELECT doc, bars, round_even(sum(la), 3) AS beats, round_even(sum(lb), 3) AS other FROM d GROUP BY ALL)),
    c AS (SELECT doc, arg_max(b, (n, -first)) AS common, max(n) AS times FROM (SELECT doc, round_even(beats, 1) AS b, count(*) AS n, min(measure) AS first FROM m GROUP BY ALL) GROUP BY doc),
    o AS (SELECT m.doc, count_if(desync) AS desynced, count_if(CASE {_METRE.replace("doc", "m.doc")} WHEN '4/4' THEN abs(beats - 4) > 0.3 AND NOT ((measure = 1 OR measure = last) AND beats < 4)
      WHEN '3/4' THEN abs(beats - 3) > 0.3 AND NOT ((measure = 1 OR measure = last) AND beats < 3) ELSE last >= 3 AND times >= 2 AND measure > 1 AND measure < last AND abs(beats - common) > 0.4 END) AS off FROM m JOIN c ON c.doc = m.doc GROUP BY m.doc),
    k AS (SELECT doc, count_if(p = 'r') AS rests, count_if(p <> 'r') AS notes, doc % 3 > 0 AND bool_and(a = b) AS twin FROM d GROUP BY doc),
    i AS (SELECT *, sum((p IS DISTINCT FROM prev)::INT) OVER (PARTITION BY doc ORDER BY event_id) AS island FROM (SELECT *, lag(p) OVER (PARTITION BY doc ORDER BY event_id) AS prev FROM d)),
    r AS (SELECT doc, max(n) AS run, sum(n) AS tokens FROM (SELECT doc, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY doc),
    x AS (SELECT u.doc, {_WIDTH.replace("doc", "u.doc")} AS w, coalesce(notes, 0) AS notes, coalesce(rests, 0) AS rests, coalesce(twin, false) AS twin, coalesce(desynced, 0) AS desynced, coalesce(off, 0) AS off, coalesce(run, 0) AS run, coalesce(tokens, 0) AS tokens
      FROM (SELECT DISTINCT doc FROM t) u LEFT JOIN k USING (doc) LEFT JOIN o USING (doc) LEFT JOIN r USING (doc)),
    y AS (SELECT *, coalesce(w > 0 AND w < 250 AND notes > 20, false) AS crowded, coalesce(w >= 600 AND notes = 0, false) AS dropped FROM x),
    z AS (SELECT doc, list_filter([{{'a': CASE WHEN doc % 11 = 3 THEN 'SPINE_MISALIGNMENT' END, 'p': 0.5::DOUBLE}}, {{'a': CASE WHEN doc % 5 = 0 THEN 'TABLATURE_CONTAMINATION' END, 'p': 0.4::DOUBLE}},
      {{'a': CASE WHEN desynced > 0 THEN 'VOICE_DESYNCHRONIZATION' END, 'p': least(0.35::DOUBLE, 0.1::DOUBLE * desynced)}}, {{'a': CASE WHEN twin THEN 'DUPLICATE_VOICE' END, 'p': 0.25::DOUBLE}},
      {{'a': CASE WHEN off > 0 THEN 'DURATION_IMBALANCE' END, 'p': least(0.35::DOUBLE, 0.1::DOUBLE * off)}}, {{'a': CASE WHEN notes = 0 AND rests = 0 THEN 'ZERO_NOTES_DETECTED' END, 'p': 0.85::DOUBLE}},
      {{'a': CASE WHEN notes = 0 AND rests > 0 THEN 'RESTS_ONLY' END, 'p': 0.4::DOUBLE}}, {{'a': CASE WHEN crowded THEN 'EXCESSIVE_NOTE_DENSITY' END, 'p': 0.4::DOUBLE}},
      {{'a': CASE WHEN NOT crowded AND w > 0 AND w < 400 AND notes / w::DOUBLE * 100 > 18 THEN 'HIGH_NOTE_DENSITY' END, 'p': 0.3::DOUBLE}}, {{'a': CASE WHEN dropped THEN 'DROPPED_STAFF' END, 'p': 0.45::DOUBLE}},
      {{'a': CASE WHEN NOT dropped AND w >= 800 AND notes <= 1 AND rests <= 1 THEN 'SPARSE_DROPPED_STAFF' END, 'p': 0.35::DOUBLE}}, {{'a': CASE WHEN tokens >= 8 AND run >= 8 THEN 'CONSECUTIVE_NOTE_LOOP' END, 'p': 0.35::DOUBLE}}], lambda q: q.a IS NOT NULL) AS q FROM y),
    s AS (SELECT doc, list_transform(q, lambda v: v.a) AS a, round(greatest(0, least(1, 1 - coalesce(list_sum(list_transform(q, lambda v: v.p)), 0))), 6)::DOUBLE AS score, doc % 13 = 5 AS missing FROM z)
    SELECT doc, CASE WHEN missing THEN 0 ELSE score END::DOUBLE AS score, NOT missing AND score >= 0.65 AND NOT list_has_any(a, ['SPINE_MISALIGNMENT', 'DROPPED_STAFF']) AS is_valid, CASE WHEN missing THEN 'EMPTY_OR_ERROR' ELSE array_to_string(a, ',') END AS anomalies,
    CASE WHEN NOT missing THEN {_METRE} END AS signature, CASE WHEN missing THEN '' ELSE {_CLEF} END AS clefs FROM s""",
)
def not_07_voices(spark, sf_dir):
    """The report with its anomalies over documents of two voices, with the verdict on their columns."""
    r = N.validate(voice_docs(spark, sf_dir), K.spines_valid(F.split("raw_kern", "\n")))
    return r.select("doc", "score", "is_valid", F.array_join("anomalies", ",").alias("anomalies"), "signature", F.array_join("clefs", ",").alias("clefs"))
