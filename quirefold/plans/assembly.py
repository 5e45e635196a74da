"""Stub and assembly queries. Conversations are pages: user turns are text with a tag, assistant turns its notation.

Notation of every seventh conversation is left out, so that tags without notes occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly as A
from ..sources import files
from .registry import query, shared, table

_W = """p AS (SELECT conv_id AS page, turn, format('P{:04d}_S{:02d}_staff', conv_id, turn) AS stub, trim(text) AS body FROM conversations WHERE role = 'user'),
n AS (SELECT conv_id AS page, format('P{:04d}_S{:02d}_staff', conv_id, turn - 1) AS stub, text AS abc FROM conversations WHERE role = 'assistant' AND conv_id % 7 <> 0),
b AS (SELECT page, stub, CASE WHEN coalesce(trim(abc), '') <> '' THEN e'```abc\\n' || trim(abc) || e'\\n```' END AS block FROM n)"""


def tagged(spark, sf_dir):
    """(page, turn, stub, body) of user turns."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.col("conv_id").alias("page"), "turn", X.stub_id(F.col("conv_id"), F.col("turn"), F.lit("staff")).alias("stub"), F.trim("text").alias("body"))


def notes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant' and conv_id % 7 <> 0")
    return c.select(F.col("conv_id").alias("page"), X.stub_id(F.col("conv_id"), F.col("turn") - 1, F.lit("staff")).alias("stub"), F.col("text").alias("abc"), F.lit(None).cast("string").alias("kern"))


@query("joi_01", f"WITH {_W} SELECT p.page, p.stub, block FROM p LEFT JOIN b USING (page, stub)")
def joi_01(spark, sf_dir):
    """Tags with their notation, exact names."""
    n = notes(spark, sf_dir)
    return tagged(spark, sf_dir).join(n.select("page", "stub", A.block(F.col("abc"), F.col("kern")).alias("block")), ["page", "stub"], "left").select("page", "stub", "block")


@query("joi_02", "WITH w AS (SELECT c_custkey // 10 AS page, format('X_P{:04d}_S{:02d}', c_custkey // 10, c_custkey % 10) AS stub, c_custkey % 4 AS kind FROM customer), f AS (SELECT page, stub, CASE kind WHEN 0 THEN stub WHEN 1 THEN 'pre_' || stub WHEN 2 THEN 'B_' || stub[3:] END AS name FROM w WHERE kind < 3), c AS (SELECT w.page, w.stub, f.name, CASE WHEN f.name = w.stub THEN 1 WHEN suffix(f.name, w.stub) THEN 2 ELSE 3 END AS rank FROM w JOIN f ON w.page = f.page AND (suffix(f.name, w.stub) OR suffix(f.name, regexp_extract(w.stub, '(P\\d+.*)$', 1)))) SELECT page, stub, name, rank::INTEGER AS rank FROM c QUALIFY row_number() OVER (PARTITION BY page, stub ORDER BY c.rank, name) = 1")
def joi_02(spark, sf_dir):
    """Names that only end alike: by rank, the first of equals."""
    w = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 10").alias("page"), F.format_string("X_P%04d_S%02d", F.expr("c_custkey div 10"), F.expr("c_custkey % 10")).alias("stub"), (F.col("c_custkey") % 4).alias("kind"))
    name = F.when(F.col("kind") == 0, F.col("stub")).when(F.col("kind") == 1, F.concat(F.lit("pre_"), "stub")).otherwise(F.concat(F.lit("B_"), F.expr("substring(stub, 3)")))
    files = w.where("kind < 3").select("page", name.alias("name"), F.lit("x").alias("body"))
    return A.resolve(w, files).select("page", "stub", "name", "rank")


@query("joi_03", f"WITH {_W}, s AS (SELECT conv_id AS page, format('P{{:04d}}_S{{:02d}}_staff', conv_id, turn) AS stub FROM conversations) SELECT s.page, s.stub FROM s ANTI JOIN p USING (page, stub)")
def joi_03(spark, sf_dir):
    """Stubs of a page that its text does not name."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), X.stub_id(F.col("conv_id"), F.col("turn"), F.lit("staff")).alias("stub"))
    return own.join(tagged(spark, sf_dir), ["page", "stub"], "left_anti")


@query("joi_06", f"WITH {_W} SELECT p.page, p.stub FROM p SEMI JOIN n USING (page, stub)")
def joi_06(spark, sf_dir):
    """Named stubs that exist."""
    return tagged(spark, sf_dir).select("page", "stub").join(notes(spark, sf_dir), ["page", "stub"], "left_semi")


_PAGES = f"WITH {_W}, t AS (SELECT page, string_agg(coalesce(body, '') || CASE WHEN block IS NULL THEN e'\\n\\n<!-- MUSIC_STUB_ID: ' || stub || e' (Notes not found, awaiting OMR) -->\\n\\n' ELSE e'\\n\\n' || block || e'\\n\\n' END, '' ORDER BY turn) AS text FROM p LEFT JOIN b USING (page, stub) GROUP BY page)"


def injected(spark, sf_dir):
    t = tagged(spark, sf_dir)
    row = F.struct("turn", F.concat(F.coalesce("body", F.lit("")), F.lit("<!-- MUSIC_STUB_ID: "), "stub", F.lit(" -->")).alias("s"))
    pages = t.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["s"]), "").alias("text"))
    return A.inject(pages, notes(spark, sf_dir), t.select("page", "stub"))


@query("api_05", _PAGES + " SELECT page, text FROM t")
def api_05(spark, sf_dir):
    """Page texts with their notation in place."""
    return injected(spark, sf_dir)


@query("agg_01", _PAGES + " SELECT page // 10 AS book, string_agg(format('<!-- PAGE {:04d} -->', page) || chr(10) || text, e'\\n\\n---\\n\\n' ORDER BY page) AS text FROM t GROUP BY ALL")
def agg_01(spark, sf_dir):
    """Books of pages in order, with page marks."""
    return A.book(injected(spark, sf_dir).select(F.expr("page div 10").alias("book"), "page", "text"))


@query("agg_02", "SELECT concat_ws('/', lang, (doc_id // 100)::VARCHAR) AS book, string_agg(coalesce(text, ''), e'\\n\\n---\\n\\n' ORDER BY doc_id) AS text FROM documents GROUP BY ALL")
def agg_02(spark, sf_dir):
    """Books without page marks: every document, a book for each language's documents of a hundred ids."""
    d = table(spark, sf_dir, "documents")
    return A.book(d.select(F.concat_ws("/", "lang", F.expr("doc_id div 100").cast("string")).alias("book"), F.col("doc_id").alias("page"), "text"), markers=False)


@query("snk_03", _PAGES + " SELECT page // 10 AS book, count(*)::BIGINT AS pages, sum(length(text))::BIGINT AS chars FROM t GROUP BY ALL")
def snk_03(spark, sf_dir):
    """Each finished book as a file; its pages and their size as the file has them."""
    books = A.book(injected(spark, sf_dir).select(F.expr("page div 10").alias("book"), "page", "text"))
    folder = files.write_texts(books.select(F.format_string("%d_complete.md", "book").alias("name"), F.col("text").alias("body")), f"{shared(spark)}/books")
    pages = F.split("body", r"(?:\A|\n\n---\n\n)<!-- PAGE \d+ -->\n")  # the first part stands before the first mark
    x = files.read_texts(spark, folder).select(F.regexp_extract("name", r"\A(-?\d+)_", 1).cast("long").alias("book"), F.slice(pages, F.lit(2), F.size(pages)).alias("p"))
    return x.select("book", F.size("p").cast("long").alias("pages"), F.aggregate("p", F.lit(0).cast("long"), lambda n, t: n + F.length(t)).alias("chars"))


@query("snk_02", _PAGES + ", k AS (SELECT unnest(['page_' || page || '.md', 'page_' || page || '_final.md']) AS name, length(text) AS n FROM t) SELECT name, n::BIGINT AS length FROM k")
def snk_02(spark, sf_dir):
    """Each page in files of its two names, read back."""
    p = F.col("page").cast("string")
    names = F.array(F.concat(F.lit("page_"), p, F.lit(".md")), F.concat(F.lit("page_"), p, F.lit("_final.md")))
    pages = injected(spark, sf_dir).select(F.explode(names).alias("name"), F.col("text").alias("body"))
    folder = files.write_texts(pages, f"{shared(spark)}/pages")
    return files.read_texts(spark, folder).select("name", F.length("body").cast("long").alias("length"))


@query("agg_15", f"WITH {_W} SELECT page, list(DISTINCT stub ORDER BY stub) AS x, count(DISTINCT stub)::BIGINT AS n FROM p GROUP BY page".replace("list(DISTINCT stub ORDER BY stub) AS x, ", "array_to_string(list_sort(list(DISTINCT stub)), ',') AS stubs, "))
def agg_15(spark, sf_dir):
    """Distinct stubs of a page."""
    return tagged(spark, sf_dir).groupBy("page").agg(F.array_join(F.array_sort(F.collect_set("stub")), ",").alias("stubs"), F.count_distinct("stub").alias("n"))


@query("prj_01", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'grand_staff' WHEN 1 THEN 'system' ELSE 'staff' END AS cls FROM lineitem")
def prj_01(spark, sf_dir):
    """Class named in a stub id."""
    kind = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'grand_staff' WHEN 1 THEN 'system' ELSE 'staff' END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.stub_class(X.stub_id(F.col("l_orderkey"), F.col("l_linenumber"), kind)).alias("cls"))


@query("prj_02", "SELECT format('P{:04d}_S{:02d}_staff', l_orderkey, l_linenumber) AS stub, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def prj_02(spark, sf_dir):
    """Stub ids."""
    return table(spark, sf_dir, "lineitem").groupBy(X.stub_id(F.col("l_orderkey"), F.col("l_linenumber"), F.lit("staff")).alias("stub")).agg(F.count("*").alias("n"))


@query("set_01", "SELECT conv_id AS page, role AS name FROM conversations UNION SELECT page_id, split_part(url, '/', 3) FROM pages")
def set_01(spark, sf_dir):
    """Union of two listings, each name once."""
    a = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("role").alias("name"))
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.split_part("url", F.lit("/"), F.lit(3)).alias("name"))
    return a.unionByName(b).distinct()


@query("set_02", "SELECT DISTINCT conv_id AS page, turn FROM conversations EXCEPT SELECT conv_id, turn FROM conversations WHERE role = 'assistant'")
def set_02(spark, sf_dir):
    """Expected but not put in."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("page"), "turn").exceptAll(c.where("role = 'assistant'").select("conv_id", "turn")).distinct()


_KEY = "SELECT conv_id, turn, 'book_' || format('P{:04d}', conv_id) || '_S' || turn || '_staff.png' AS name FROM conversations"


@query("joi_09", f"WITH c AS ({_KEY}), k AS (SELECT regexp_extract(name, 'P(\\d{{4,}})_', 1)::BIGINT AS page, name FROM c) SELECT p.page_id, count(name)::BIGINT AS crops, min(name) AS first FROM pages p LEFT JOIN k ON k.page = p.page_id GROUP BY ALL")
def joi_09(spark, sf_dir):
    """Crops of each page by the number in their name."""
    page = F.when(F.col("conv_id").isNotNull(), F.format_string("book_P%04d_S", "conv_id"))  # pads, never cuts
    name = F.concat(page, F.col("turn").cast("string"), F.lit("_staff.png"))
    crops = table(spark, sf_dir, "conversations").select(name.alias("name")).withColumn("page_id", F.regexp_extract("name", r"P(\d{4,})_", 1).cast("long"))
    return table(spark, sf_dir, "pages").select("page_id").join(crops, "page_id", "left").groupBy("page_id").agg(F.count("name").alias("crops"), F.min("name").alias("first"))


@query("api_04", f"WITH c AS ({_KEY}), k AS (SELECT regexp_extract(name, 'P(\\d{{4,}})_', 1)::BIGINT AS page, count(*) AS n FROM c GROUP BY ALL) SELECT page_id, 'Page ' || page_id AS title, coalesce(n, 0)::BIGINT AS crops_count FROM pages LEFT JOIN k ON k.page = page_id")
def api_04(spark, sf_dir):
    """Pages with their numbers of crops."""
    n = joi_09(spark, sf_dir)
    return n.select("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.col("crops").alias("crops_count"))


@query("api_10", f"WITH c AS ({_KEY}) SELECT conv_id, turn, name FROM c WHERE regexp_matches(name, '(?:^|_)P0*[123]_S\\d+')")
def api_10(spark, sf_dir):
    """Crops of pages 1 to 3 by the lookup's pattern."""
    page = F.when(F.col("conv_id").isNotNull(), F.format_string("book_P%04d_S", "conv_id"))
    name = F.concat(page, F.col("turn").cast("string"), F.lit("_staff.png"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name")).where(F.col("name").rlike(r"(?:^|_)P0*[123]_S\d+"))


@query("joi_10", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'deskew' END, CASE WHEN b.item_id IS NOT NULL THEN 'abc' END, CASE WHEN d.doc_id % 2 = 0 THEN 'kern' END, 'none') AS best FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def joi_10(spark, sf_dir):
    """The first of several companions that exists."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    x = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("abc").alias("abc")), "doc_id", "left")
    return x.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "deskew"), "abc", F.when(F.col("doc_id") % 2 == 0, "kern"), F.lit("none")).alias("best"))


@query("joi_11", "WITH c AS (SELECT conv_id AS page, turn % 6 AS rank, text FROM conversations) SELECT page, rank::INTEGER AS rank, length(text)::BIGINT AS length FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY c.rank, text) = 1")
def joi_11(spark, sf_dir):
    """The first existing candidate in order of preference."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.struct((F.col("turn") % 6).alias("rank"), "text").alias("c"))
    best = c.groupBy("page").agg(F.min("c").alias("c"))
    return best.select("page", F.col("c.rank").cast("int").alias("rank"), F.length("c.text").cast("long").alias("length"))
