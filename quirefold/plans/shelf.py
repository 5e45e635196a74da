"""Queries over files that they write first: folders of books, settings, checkpoints, sidecars, pictures, what pruning leaves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import staves as V
from ..sources import files
from .registry import query, shared, table


def _books(spark, sf_dir):
    """One book for each supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))


_STATUS = "CASE s_suppkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'completed' ELSE 'processing' END"
_FOUND = "'book_' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '.txt' ELSE '.pdf' END"


@query(
    "src_01",
    f"""WITH q AS (SELECT 'book_' || s_suppkey || '.pdf' AS name, {_STATUS} AS status FROM supplier WHERE s_suppkey % 3 <> 0), f AS (SELECT {_FOUND} AS name FROM supplier WHERE s_suppkey % 5 <> 0),
    j AS (SELECT coalesce(q.name, f.name) AS name, coalesce(status, 'pending') AS status, q.name IS NULL AS added FROM q FULL JOIN f USING (name) WHERE f.name IS NOT NULL OR status NOT IN ('pending', 'error'))
    SELECT *, row_number() OVER (ORDER BY added, name)::BIGINT AS place FROM j""",
)
def src_01(spark, sf_dir):
    """The saved queue after a scan of its folder: new PDFs join behind it, missing ones go if nothing was done to them, places are given anew."""
    folder, s = shared(spark), table(spark, sf_dir, "supplier")
    files.write_texts(s.select(F.expr(_FOUND).alias("name"), F.lit("%PDF-").alias("body")), f"{folder}/in")
    saved = s.where("s_suppkey % 3 <> 0").select(F.expr("'book_' || s_suppkey || '.pdf'").alias("name"), F.expr(_STATUS).alias("status"))
    q = files.read_records(spark, files.write_records(saved, f"{folder}/queue"), saved.schema).withColumn("queued", F.lit(True))
    f = files.listing(spark, f"{folder}/in").where(F.lower("name").endswith(".pdf")).select("name", F.lit(True).alias("there"))
    kept = q.join(f, "name", "full_outer").where(F.col("there").isNotNull() | ~F.col("status").isin("pending", "error"))
    kept = kept.select("name", F.coalesce("status", F.lit("pending")).alias("status"), F.col("queued").isNull().alias("added"))
    # places by blocks of names, so that no task orders the whole queue
    kept = kept.withColumn("block", F.substring("name", 1, 7))
    before = kept.groupBy("added", "block").agg(F.count("*").alias("n"))
    before = before.select("added", "block", F.coalesce(F.sum("n").over(Window.orderBy("added", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("added", "block").orderBy("name"))
    return kept.withColumn("own", own).join(before, ["added", "block"]).select("name", "status", "added", (F.col("before") + F.col("own")).alias("place"))


@query(
    "src_02",
    """WITH f AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'in/' ELSE 'more/' END AS folder, 'f' || s_suppkey // 2 || CASE WHEN s_suppkey // 2 % 9 = 8 THEN '.TXT' ELSE '.PDF' END AS name, CASE WHEN s_suppkey % 10 = 1 THEN 0 ELSE s_suppkey % 13 END AS pages, s_suppkey // 2 AS k FROM supplier)
    SELECT name, min_by(pages, folder)::INTEGER AS pages, CASE WHEN any_value(k) % 4 = 0 THEN 'completed' ELSE 'pending' END AS status FROM f WHERE name LIKE '%.PDF' GROUP BY name""",
)
def src_02(spark, sf_dir):
    """Files taken in: PDFs only, each base name once, pages as the file says, status as its checkpoint says."""
    folder, s = shared(spark), _books(spark, sf_dir)
    name = F.expr("'f' || s div 2 || CASE WHEN s div 2 % 9 = 8 THEN '.TXT' ELSE '.PDF' END")
    body = F.concat(F.when(F.col("s") % 10 == 1, "broken").otherwise("%PDF-1.4 /Type /Pages "), F.expr("repeat('<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources 5 0 R >> obj\n', int(s % 13))"))
    files.write_texts(s.select(F.concat(F.expr("CASE WHEN s % 2 = 0 THEN 'in/' ELSE 'more/' END"), name).alias("name"), body.alias("body")), f"{folder}/files")
    marks = s.where("s div 2 % 4 = 0").select(name.alias("name"), F.lit("completed").alias("status")).distinct()
    marks = files.read_records(spark, files.write_records(marks, f"{folder}/marks"), marks.schema)
    found = files.read_texts(spark, f"{folder}/files").where(F.lower("name").endswith(".pdf"))
    once = found.groupBy(F.regexp_extract("name", r"([^/]*)\z", 1).alias("base")).agg(F.min_by(files.page_count(F.col("body")), F.col("name")).alias("pages"))
    return once.withColumnRenamed("base", "name").join(marks, "name", "left").select("name", "pages", F.coalesce("status", F.lit("pending")).alias("status"))


@query("src_06", "SELECT p_partkey, (p_partkey % 40 + 1)::INTEGER AS width, p_size::INTEGER AS height FROM part WHERE p_size > 0")
def src_06(spark, sf_dir):
    """Sizes of stored pictures, of whose bytes only the header is looked at."""
    folder = f"{shared(spark)}/pictures"
    p = table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", "p_size", (F.col("p_partkey") % 40 + 1).cast("int").alias("width"))
    p.select("p_partkey", V.png_of("p_size", "width", F.expr("cast(repeat(' ', p_size * width) as binary)")).alias("png")).write.parquet(folder)
    size = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
    return spark.read.parquet(folder).select("p_partkey", size(17).alias("width"), size(21).alias("height"))


@query(
    "src_07",
    """WITH b AS (SELECT 'book_' || s_suppkey AS name, s_suppkey AS s FROM supplier), k AS (SELECT unnest(['dpi', 'delay', 'overwrite', 'user']) AS key)
    SELECT name, key, CASE key WHEN 'dpi' THEN CASE WHEN s % 7 <> 0 AND s % 2 = 0 THEN (s % 5 * 100)::VARCHAR ELSE '200' END WHEN 'delay' THEN '0.5' WHEN 'overwrite' THEN 'false' ELSE 'u' || s END AS value
    FROM b, k WHERE key <> 'user' OR s % 7 <> 0""",
)
def src_07(spark, sf_dir):
    """Settings files over the defaults; a broken file is none."""
    s = _books(spark, sf_dir)
    given = F.when(F.col("s") % 2 == 0, F.create_map(F.lit("dpi"), (F.col("s") % 5 * 100).cast("string"), F.lit("user"), F.expr("'u' || s"))).otherwise(F.create_map(F.lit("user"), F.expr("'u' || s")))
    body = F.when(F.col("s") % 7 == 0, "{broken").otherwise(F.to_json(given))
    folder = files.write_texts(s.select(F.expr("'book_' || s").alias("name"), body.alias("body")), f"{shared(spark)}/settings")
    defaults = F.expr("map('dpi', '200', 'delay', '0.5', 'overwrite', 'false')")
    read = files.read_texts(spark, folder).select("name", files.overlay(defaults, F.from_json("body", "map<string,string>")).alias("m"))
    return read.select("name", F.explode("m").alias("key", "value"))


@query("src_08", "SELECT s_suppkey::BIGINT AS book, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_suppkey * 3 END::BIGINT AS pages, s_suppkey % 7 <> 0 AS stamped FROM supplier")
def src_08(spark, sf_dir):
    """Checkpoints written with the time of writing and read back; broken ones are none, here -1."""
    s = _books(spark, sf_dir)
    body = F.to_json(F.struct((F.col("s") * 3).alias("pages"), F.current_timestamp().alias("last_updated")))
    marks = s.select(F.col("s").cast("string").alias("name"), F.when(F.col("s") % 7 == 0, F.substring(body, 1, 9)).otherwise(body).alias("body"))
    read = files.read_texts(spark, files.write_texts(marks, f"{shared(spark)}/marks"))
    mark = F.from_json("body", "pages long, last_updated timestamp")
    return read.select(F.col("name").cast("long").alias("book"), F.coalesce(mark["pages"], F.lit(-1)).alias("pages"), mark["last_updated"].isNotNull().alias("stamped"))


@query("src_09", "SELECT doc_id, (length(coalesce(text, '')) + (doc_id % 5 = 0)::INT)::BIGINT AS n, len(string_split(coalesce(text, ''), chr(10)))::INTEGER AS lines FROM documents")
def src_09(spark, sf_dir):
    """Sidecar files read whole; a byte that is no UTF-8 (written into every fifth) counts as one replacement mark."""
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("FF")), F.coalesce("text", F.lit("")).cast("binary")).cast("string")).otherwise(F.col("text"))
    name = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".abc", ".kern", ".md"))), (F.col("doc_id") % 3 + 1).cast("int")))
    read = files.read_texts(spark, files.write_texts(d.select(name.alias("name"), raw.alias("body")), f"{shared(spark)}/sidecars"))
    text = files.whole(F.col("body"))
    return read.select(F.regexp_extract("name", r"\A(\d+)", 1).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), F.size(F.split(text, "\n")).alias("lines"))


@query(
    "snk_06",
    """WITH f AS (SELECT 'book_' || s_suppkey % 50 AS book, CASE s_suppkey % 4 WHEN 0 THEN 'masked' WHEN 1 THEN 'raw_md' WHEN 2 THEN 'deskew' ELSE 'final' END AS kind, s_suppkey % 9 * 1000 AS n FROM supplier)
    SELECT book, count_if(kind <> 'final')::BIGINT AS removed, coalesce(sum(n) FILTER (kind <> 'final'), 0)::BIGINT AS freed, count_if(kind = 'final')::BIGINT AS kept FROM f GROUP BY book""",
)
def snk_06(spark, sf_dir):
    """Intermediate files deleted: how many and how many bytes, by the listings before and after."""
    s = _books(spark, sf_dir)
    kind = F.expr("CASE s % 4 WHEN 0 THEN 'masked' WHEN 1 THEN 'raw_md' WHEN 2 THEN 'deskew' ELSE 'final' END")
    folder = f"{shared(spark)}/work"
    files.write_kinds(s.select(kind.alias("kind"), F.expr("'book_' || s % 50 || '/' || s").alias("name"), F.expr("repeat('x', int(s % 9 * 1000))").alias("body")), folder)
    before = f"{folder}-before"
    files.manifest(spark, folder).write.parquet(before)
    files.prune(spark, folder, ("masked", "raw_md", "deskew", "none_such"))
    after = files.manifest(spark, folder).select("kind", "name", F.lit(True).alias("left"))
    j = spark.read.parquet(before).join(after, ["kind", "name"], "left")
    gone = F.col("left").isNull()
    return j.groupBy(F.split_part("name", F.lit("/"), F.lit(1)).alias("book")).agg(F.count_if(gone).alias("removed"), F.coalesce(F.sum(F.when(gone, F.col("length"))), F.lit(0)).alias("freed"), F.count_if(~gone).alias("kept"))
