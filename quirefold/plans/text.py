"""Text hygiene queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query, table

_BOOK = "source || '/' || lang || ': ' || doc_id || '. '"


@query("str_01", f"SELECT doc_id, coalesce(nullif(trim(regexp_replace({_BOOK}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '. '), ''), 'unnamed_book') AS title FROM documents")
def str_01(spark, sf_dir):
    """Folder names of titles."""
    return table(spark, sf_dir, "documents").select("doc_id", X.book_title(F.concat("source", F.lit("/"), "lang", F.lit(": "), F.col("doc_id").cast("string"), F.lit(". "))).alias("title"))


@query("str_02")
def str_02(spark, sf_dir):
    """Thinking passages and fences come off whole texts, loops are cut (sequential, so held against worked examples)."""
    x = F.concat(F.lit("<think>"), "source", F.lit("</think>\n```"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'md' ELSE '' END"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_fences(x).alias("body"))


@query("str_04")
def str_04(spark, sf_dir):
    """Phrases that stand three times or more in a row stay twice."""
    phrase = F.concat(F.lit("the same phrase again "), "source", F.lit("; "))
    return table(spark, sf_dir, "documents").select("doc_id", X.cut_inline_loops(F.concat(F.repeat(phrase, (F.col("doc_id") % 6).cast("int")), F.coalesce("text", F.lit("")))).alias("body"))


@query(
    "str_05",
    r"""SELECT event_id, (n > 0 AND length(x) >= 24 AND (len(list_filter(range(8, least(120, length(s) // 3) + 1), lambda m: suffix(s, repeat(right(s, m), 3)))) > 0
  OR len(list_filter(range(1, 6), lambda p: len(l) >= 3 * p AND l[len(l) - p + 1:] = l[len(l) - 2 * p + 1:len(l) - p] AND l[len(l) - p + 1:] = l[len(l) - 3 * p + 1:len(l) - 2 * p])) > 0)) AS looped
FROM (SELECT *, trim(x, e' \n') AS s, list_filter(string_split(x, e'\n'), lambda y: trim(y) <> '') AS l FROM (SELECT event_id, event_id % 5 AS n, event_type || ' ' || user_id || e'\n' || repeat(event_type || e' row\n', (event_id % 5)::INT) AS x FROM events))""",
)
def str_05(spark, sf_dir):
    """Does a stream's tail loop?"""
    x = F.expr("concat(event_type, ' ', user_id, '\n', repeat(concat(event_type, ' row\n'), int(event_id % 5)))")
    return table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 5 > 0) & X.streaming_loop(x)).alias("looped"))


@query("str_06", r"SELECT page_id, i::INTEGER AS i, stubs[i] AS stub FROM (SELECT page_id, stubs, unnest(range(1, len(stubs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(x, '<!--\s*MUSIC_STUB_ID:\s*(.*?)\s*-->', 1) AS stubs FROM (SELECT page_id, url || ' <!-- MUSIC_STUB_ID: P' || page_id || '_S01 --> ' || page_id || '<!--MUSIC_STUB_ID:S2-->' AS x FROM pages)))")
def str_06(spark, sf_dir):
    """Stub tags of a text, in order."""
    x = F.expr("concat(url, ' <!-- MUSIC_STUB_ID: P', page_id, '_S01 --> ', page_id, '<!--MUSIC_STUB_ID:S2-->')")
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(x, F.lit(X.STUB), 1)).alias("i", "stub")).withColumn("i", F.col("i") + 1)


@query("str_07", "SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' OR turn % 3 = 2 THEN NULL ELSE e'```abc\\n' || trim(text) || e'\\n```' END AS block FROM conversations")
def str_07(spark, sf_dir):
    """Notation in a fence; failed and empty ones give none."""
    body = F.when(F.col("turn") % 3 == 2, F.lit(X.FAILED + "]")).otherwise(F.col("text"))
    empty = F.coalesce(body, F.lit("")) == ""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(~empty & ~F.startswith(body, F.lit(X.FAILED)), X.fenced("abc", body)).alias("block"))


@query("str_08", "SELECT page_id, '## Page ' || page_id || e'\\n\\n' || CASE WHEN length(html) < 2000 THEN '<!-- Blank page -->' ELSE '<!-- Page contains no musical material -->' END AS head FROM pages")
def str_08(spark, sf_dir):
    """Synthesised page headers."""
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.format_string("## Page %d\n\n", "page_id"), F.when(F.length("html") < 2000, "<!-- Blank page -->").otherwise("<!-- Page contains no musical material -->")).alias("head"))


@query("str_09", r"SELECT page_id, regexp_replace(regexp_replace(x, '<svg class=""definition-scale""[^>]*>', '<g>', 'g'), '</svg></svg>', '</g></svg>', 'g') AS flat FROM (SELECT page_id, '<svg><svg class=""definition-scale"" viewBox=""0 0 ' || page_id || ' 9"">x</svg></svg>' AS x FROM pages)".replace('""', '"'))
def str_09(spark, sf_dir):
    """Nested drawings become groups."""
    x = F.expr("""concat('<svg><svg class="definition-scale" viewBox="0 0 ', page_id, ' 9">x</svg></svg>')""")
    flat = F.regexp_replace(F.regexp_replace(x, '<svg class="definition-scale"[^>]*>', "<g>"), "</svg></svg>", "</g></svg>")
    return table(spark, sf_dir, "pages").select("page_id", flat.alias("flat"))


_ABC = "'X:1' || chr(10) || 'T:Music21' || chr(10) || 'C:Music21' || chr(10) || 'K:C' || chr(10) || p_name"


@query("str_10", f"SELECT p_partkey, array_to_string(list_concat(['X:1', 'T:' || p_name], list_filter(string_split({_ABC}, chr(10))[2:], lambda l: NOT (l ILIKE 't:%' OR l ILIKE 'c:music21%'))), chr(10)) AS abc FROM part")
def str_10(spark, sf_dir):
    """The tool's own title and composer lines go; the given title stands behind X:."""
    lines = F.split(F.expr(_ABC.replace("||", "||").replace("chr(10)", "'\n'")), "\n")
    kept = F.filter(F.slice(lines, 2, 1 << 20), lambda x: ~F.lower(x).rlike("^(t:|c:music21)"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.concat(F.array(F.lit("X:1"), F.concat(F.lit("T:"), "p_name")), kept), "\n").alias("abc"))


@query("str_11", "SELECT p_partkey, 'X:1' || chr(10) || 'T:' || p_name || chr(10) || 'M:4/4' || chr(10) || 'L:1/8' || chr(10) || 'K:C' AS head FROM part")
def str_11(spark, sf_dir):
    """Header of a fallback text."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", F.lit("X:1"), F.concat(F.lit("T:"), "p_name"), F.lit("M:4/4"), F.lit("L:1/8"), F.lit("K:C")).alias("head"))


@query("str_13", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def str_13(spark, sf_dir):
    """Escaped HTML."""
    return table(spark, sf_dir, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query("str_14", r"SELECT event_id, left(regexp_replace(x, '^\[?[0-9.:]+\]?\s*', ''), 160) AS msg FROM (SELECT event_id, '[12:03:' || event_id || '] ' || event_type || ' ' || repeat(props, 20) AS x FROM events)")
def str_14(spark, sf_dir):
    """Log lines without their stamp, 160 characters."""
    x = F.expr("concat('[12:03:', event_id, '] ', event_type, ' ', repeat(props, 20))")
    return table(spark, sf_dir, "events").select("event_id", F.left(F.regexp_replace(x, r"^\[?[0-9.:]+\]?\s*", ""), F.lit(160)).alias("msg"))


@query("str_15", "SELECT event_id, event_id % 9 >= 6 AS degenerate FROM events")
def str_15(spark, sf_dir):
    """Six equal letters or digits in a row."""
    x = F.expr("concat('4', repeat('e', int(event_id % 9)), '.')")
    return table(spark, sf_dir, "events").select("event_id", x.rlike(r"([0-9a-zA-Z])\1{5,}").alias("degenerate"))


@query("str_17", "SELECT p_partkey, 'data:image/png;base64,' || to_base64(encode(p_name)) AS uri FROM part")
def str_17(spark, sf_dir):
    """Bytes as a data URI."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("p_name").cast("binary"))).alias("uri"))


_LINES = "l AS (SELECT doc_id, i, line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)) WHERE trim(line) <> '')"


@query("win_15", f"WITH {_LINES}, r AS (SELECT *, sum((trim(line) IS DISTINCT FROM prev)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l)), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY i) AS k FROM r) SELECT doc_id, count(*)::BIGINT AS lines, count_if(k <= 2)::BIGINT AS kept, max(k)::BIGINT AS longest FROM n GROUP BY doc_id")
def win_15(spark, sf_dir):
    """Runs of equal lines stay twice: what that keeps of each document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    order = Window.partitionBy("doc_id").orderBy("i")
    new = ~F.col("line").eqNullSafe(F.lag("line").over(order))
    islands = lines.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("doc_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.sum(F.least("n", F.lit(2))).alias("kept"), F.max("n").alias("longest"))


@query("win_16")
def win_16(spark, sf_dir):
    """All loop passes over whole texts (sequential, so a pandas UDF)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.cut_loops(F.col("text"))).alias("n_chars"))


@query("str_03")
def str_03(spark, sf_dir):
    """Recognised page text: preamble and thinking off, stubs unescaped, invented stubs dropped, loops cut."""
    x = F.expr("concat('<think>', source, '</think>Here is the page:\n# ', doc_id, '\n&lt;!-- MUSIC_STUB_ID: P', doc_id % 3, ' --&gt;\n', coalesce(text, ''))")
    plain = F.replace(F.replace(X.strip_fences(x), F.lit("&lt;!--"), F.lit("<!--")), F.lit("--&gt;"), F.lit("-->"))
    plain = F.regexp_replace(plain, r"(?s)\A[^#<]*(?=[#<])", "")
    known = F.regexp_replace(plain, r"<!--\s*MUSIC_STUB_ID:\s*(?!P[01]\s)[^\s]*\s*-->", "")
    return table(spark, sf_dir, "documents").select("doc_id", X.cut_loops(known).alias("body"))


@query("flt_09", "SELECT conv_id, turn, NOT (contains(x, 'LM_STUDIO_ERROR') OR contains(x, '[Text not recognized') OR contains(x, 'VLM_ERROR')) AND trim(x) <> '' AS done FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<!-- VLM_ERROR -->' WHEN 1 THEN '[Text not recognized]' ELSE coalesce(text, '') END AS x FROM conversations)")
def flt_09(spark, sf_dir):
    """Texts with an error mark are to be done again."""
    x = F.expr("CASE turn % 4 WHEN 0 THEN '<!-- VLM_ERROR -->' WHEN 1 THEN '[Text not recognized]' ELSE coalesce(text, '') END")
    failed = x.contains("LM_STUDIO_ERROR") | x.contains("[Text not recognized") | x.contains("VLM_ERROR")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (~failed & (F.trim(x) != "")).alias("done"))


@query("flt_10", "SELECT event_id, regexp_matches(lower(x), 'connection|refused|timed out|timeout|offline') AS retry FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Connection reset' WHEN 1 THEN 'read Timed Out' WHEN 2 THEN event_type ELSE 'Server OFFLINE' END AS x FROM events)")
def flt_10(spark, sf_dir):
    """Errors of the connection, which are tried again."""
    x = F.expr("CASE event_id % 4 WHEN 0 THEN 'Connection reset' WHEN 1 THEN 'read Timed Out' WHEN 2 THEN event_type ELSE 'Server OFFLINE' END")
    return table(spark, sf_dir, "events").select("event_id", F.lower(x).rlike("connection|refused|timed out|timeout|offline").alias("retry"))


@query("agg_22", "SELECT doc_id, trunc(length(coalesce(text, '')) / 3.5::DOUBLE)::BIGINT AS tokens, round(trunc(length(coalesce(text, '')) / 3.5::DOUBLE) / (doc_id % 7 + 1), 6)::DOUBLE AS per_s FROM documents")
def agg_22(spark, sf_dir):
    """Token estimate and speed."""
    n = F.floor(F.length(F.coalesce("text", F.lit(""))) / 3.5)
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("tokens"), F.round(n / (F.col("doc_id") % 7 + 1), 6).cast("double").alias("per_s"))


@query("src_05", "SELECT doc_id, lower(trim(text)) AS body FROM documents WHERE trim(coalesce(text, '')) <> ''")
def src_05(spark, sf_dir):
    """Page text, trimmed and lower-cased, empty ones left out."""
    return table(spark, sf_dir, "documents").where("trim(coalesce(text, '')) <> ''").select("doc_id", F.lower(F.trim("text")).alias("body"))


# Words that mark sections of a book, by section, in order of precedence.
SECTIONS = {"toc": ("contents", "inhalt"), "front": ("preface", "copyright", "rights"), "back": ("index", "appendix", "license")}


@query("flt_02", "SELECT doc_id, p::INTEGER AS p, CASE WHEN regexp_matches(t, 'contents|inhalt') THEN 'toc' WHEN regexp_matches(t, 'preface|copyright|rights') AND p <= 15 THEN 'front' WHEN regexp_matches(t, 'index|appendix|license') AND p >= 89 THEN 'back' ELSE 'body' END AS section FROM (SELECT doc_id, doc_id % 100 + 1 AS p, lower(coalesce(text, '')) AS t FROM documents)")
def flt_02(spark, sf_dir):
    """Section of a page by keywords, the first match wins (books of 100 pages)."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100 + 1).cast("int").alias("p"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    has = {k: F.col("t").rlike("|".join(v)) for k, v in SECTIONS.items()}
    kind = F.when(has["toc"], "toc").when(has["front"] & (F.col("p") <= front_limit(F.lit(100))), "front").when(has["back"] & (F.col("p") >= back_start(F.lit(100))), "back").otherwise("body")
    return d.select("doc_id", "p", kind.alias("section"))


def front_limit(pages):
    return F.greatest(F.lit(5), F.floor(pages * 0.15).cast("int"))


def back_start(pages):
    return F.greatest(front_limit(pages) + 1, pages - F.floor(pages * 0.12).cast("int") + 1)


@query("flt_03", "SELECT p_partkey, n::INTEGER AS n, greatest(5, n * 15 // 100)::INTEGER AS front, greatest(greatest(5, n * 15 // 100) + 1, n - n * 12 // 100 + 1)::INTEGER AS back FROM (SELECT p_partkey, (p_partkey % 700 + p_size)::INTEGER AS n FROM part)")
def flt_03(spark, sf_dir):
    """Where the front matter ends and the back matter begins."""
    n = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 700 + F.col("p_size")).cast("int").alias("n"))
    return n.select("p_partkey", "n", front_limit(F.col("n")).alias("front"), back_start(F.col("n")).alias("back"))
