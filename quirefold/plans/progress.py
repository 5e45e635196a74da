"""Queue, checkpoint, manifest and log queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rounding as R
from ..sources import files
from .registry import query, shared, table

_PHASE = """ph AS (SELECT o_custkey AS book, count(*) AS total, count_if(o_orderstatus IN ('F', 'P')) AS sliced, count_if(o_orderstatus = 'F') AS omr, count_if(o_orderstatus = 'F' AND o_totalprice > 100000) AS vlm FROM orders GROUP BY ALL)"""


def phases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("book")).agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("sliced"), F.count_if(F.col("o_orderstatus") == "F").alias("omr"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).alias("vlm")
    )


@query("agg_03", f"WITH {_PHASE} SELECT book, total::BIGINT AS total, sliced::BIGINT AS sliced, omr::BIGINT AS omr, vlm::BIGINT AS vlm FROM ph")
def agg_03(spark, sf_dir):
    """Done and total of each phase of each book."""
    return phases(spark, sf_dir)


@query("agg_04", f"WITH {_PHASE}, b AS (SELECT book, round_even(0.3::DOUBLE * 100 * sliced / total + 0.3::DOUBLE * 100 * omr / total + 0.4::DOUBLE * 100 * vlm / total, 1) AS pct FROM ph) SELECT book, pct::DOUBLE AS pct, round(least(100::DOUBLE, greatest(0::DOUBLE, (row_number() OVER (ORDER BY book) - 1 + pct / 100) / count(*) OVER () * 100)), 4)::DOUBLE AS queue_pct FROM b")
def agg_04(spark, sf_dir):
    """Weighted progress of a book, and of the queue when it has come to it."""
    p = phases(spark, sf_dir)
    share = lambda weight, c: F.lit(weight) * 100 * F.col(c) / F.col("total")
    p = p.select("book", R.round_even(share(0.3, "sliced") + share(0.3, "omr") + share(0.4, "vlm"), 1).alias("pct"))
    # the place in the queue: counts by blocks of books first, so that no task orders the whole queue
    block = F.expr("book div 1000")
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.asc_nulls_last("book")))
    counts = p.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = counts.select(F.col("block").alias("b"), F.coalesce(F.sum("n").over(Window.orderBy(F.asc_nulls_last("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = counts.agg(F.sum("n").alias("total"))
    x = p.withColumn("block", block).withColumn("own", place).join(F.broadcast(before), F.col("block").eqNullSafe(F.col("b"))).join(F.broadcast(total))
    queue = (F.col("before") + F.col("own") - 1 + F.col("pct") / 100) / F.col("total") * 100
    return x.select("book", "pct", R.round_half(F.least(F.lit(100.0), F.greatest(F.lit(0.0), queue)), 4).alias("queue_pct"))


@query("stm_03", f"WITH {_PHASE} SELECT book, sliced >= total AND total > 0 AS slicing_done, sliced = 0 OR omr >= sliced AS omr_done, sliced > 0 AND vlm >= sliced AS vlm_done, CASE WHEN sliced > 0 AND vlm >= sliced THEN 'completed' WHEN sliced > 0 THEN 'in_progress' ELSE 'pending' END AS status FROM ph")
def stm_03(spark, sf_dir):
    """What is done, as the files say (they outweigh a saved checkpoint)."""
    p = phases(spark, sf_dir)
    done = (F.col("sliced") > 0) & (F.col("vlm") >= F.col("sliced"))
    return p.select("book", ((F.col("sliced") >= F.col("total")) & (F.col("total") > 0)).alias("slicing_done"), ((F.col("sliced") == 0) | (F.col("omr") >= F.col("sliced"))).alias("omr_done"), done.alias("vlm_done"), F.when(done, "completed").when(F.col("sliced") > 0, "in_progress").otherwise("pending").alias("status"))


@query("joi_04", "SELECT source, count(*)::BIGINT AS pending FROM documents d ANTI JOIN labels l USING (doc_id) GROUP BY source")
def joi_04(spark, sf_dir):
    """Crops without a result."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("pending"))


@query("joi_05", "SELECT d.doc_id FROM documents d ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def joi_05(spark, sf_dir):
    """Pages without a valid text."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_anti")


@query("stm_04", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def stm_04(spark, sf_dir):
    """A second run does only what has no output yet."""
    return table(spark, sf_dir, "documents").select("doc_id").distinct().join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


_QUEUE = "q AS (SELECT c_custkey AS id, 'book_' || c_custkey || '.pdf' AS name, CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'completed' ELSE 'processing' END AS status FROM customer WHERE c_custkey % 3 <> 0), f AS (SELECT 'book_' || c_custkey || '.pdf' AS name FROM customer WHERE c_custkey % 5 <> 0)"


def queue_and_disk(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("book_"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("name")
    status = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'completed' ELSE 'processing' END").alias("status")
    return c.where("c_custkey % 3 <> 0").select(name, status), c.where("c_custkey % 5 <> 0").select(name)


@query("joi_07", f"WITH {_QUEUE} SELECT (q.name IS NOT NULL) AS queued, (f.name IS NOT NULL) AS on_disk, count(*)::BIGINT AS n FROM q FULL JOIN f USING (name) GROUP BY ALL")
def joi_07(spark, sf_dir):
    """Queue and disk, full outer."""
    q, f = queue_and_disk(spark, sf_dir)
    j = q.withColumn("a", F.lit(1)).join(f.withColumn("b", F.lit(1)), "name", "full_outer")
    return j.groupBy(F.col("a").isNotNull().alias("queued"), F.col("b").isNotNull().alias("on_disk")).agg(F.count("*").alias("n"))


@query("src_03", f"WITH {_QUEUE}, {_PHASE} SELECT name, CASE WHEN ph.sliced > 0 AND ph.vlm >= ph.sliced THEN 'completed' WHEN status = 'processing' THEN 'pending' ELSE status END AS status, 'in/' || name AS path FROM q LEFT JOIN ph ON ph.book = q.id")
def src_03(spark, sf_dir):
    """The saved queue, its status overlaid by checkpoints."""
    saved, _ = queue_and_disk(spark, sf_dir)
    q = files.read_records(spark, files.write_records(saved, f"{shared(spark)}/queue"), saved.schema)
    q = q.withColumn("book", F.regexp_extract("name", r"book_(\d+)", 1).cast("long"))
    x = q.join(stm_03(spark, sf_dir).select("book", "vlm_done"), "book", "left")
    return x.select("name", F.when(F.coalesce("vlm_done", F.lit(False)), "completed").when(F.col("status") == "processing", "pending").otherwise(F.col("status")).alias("status"), F.concat(F.lit("in/"), "name").alias("path"))


@query("joi_08", "SELECT c_custkey, coalesce(count(o_orderkey), 0)::BIGINT AS checkpoints FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def joi_08(spark, sf_dir):
    """Queue with its checkpoints."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("checkpoints"))


@query("jsn_01", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS content FROM events")
def jsn_01(spark, sf_dir):
    """Content of a streamed delta; null where a line is no JSON."""
    js = F.when(F.col("event_id") % 5 == 0, "data: [DONE]").otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("delta"))).alias("choices"))))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(js, "$.choices[0].delta.content").alias("content"))


@query("jsn_02", "SELECT p_partkey, '{\"name\":\"' || p_name || '\",\"size\":' || p_size || '}' AS js FROM part")
def jsn_02(spark, sf_dir):
    """Records as JSON."""
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("js"))


@query("map_01", "SELECT o_custkey AS book, count_if(o_orderstatus = 'F')::BIGINT AS f, count_if(o_orderstatus = 'X')::BIGINT AS missing FROM orders GROUP BY ALL")
def map_01(spark, sf_dir):
    """Nested counters with a default."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("book"), "o_orderstatus").agg(F.count("*").alias("n"))
    m = o.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return m.select("book", F.coalesce(F.try_element_at("m", F.lit("F")), F.lit(0)).alias("f"), F.coalesce(F.try_element_at("m", F.lit("X")), F.lit(0)).alias("missing"))


@query("snk_05", f"WITH {_QUEUE} SELECT '{{\"name\":\"' || name || '\",\"path\":\"in/' || name || '\",\"status\":\"' || status || '\"}}' AS js FROM q")
def snk_05(spark, sf_dir):
    """The queue's state as JSON lines, as they stand in the file."""
    q, _ = queue_and_disk(spark, sf_dir)
    folder = files.write_records(q.select("name", F.concat(F.lit("in/"), "name").alias("path"), "status"), f"{shared(spark)}/queue")
    return spark.read.text(folder).select(F.col("value").alias("js"))


_PRUNE = "WHERE doc_id % 3 <> 0"


@query("agg_20", f"SELECT coalesce(source, '(all)') AS book, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS freed, round_even(sum(n_chars) / 1048576.0::DOUBLE, 2)::DOUBLE AS mb FROM documents {_PRUNE} GROUP BY ROLLUP (source)")
def agg_20(spark, sf_dir):
    """Freed files and bytes by book, and over all."""
    d = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return d.rollup("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("freed")).select(F.coalesce("source", F.lit("(all)")).alias("book"), "files", "freed", R.round_even(F.col("freed") / 1048576.0, 2).alias("mb"))


@query("flt_11", "SELECT doc_id FROM documents WHERE n_chars * 1024 > 1048576")
def flt_11(spark, sf_dir):
    """Weight files over 1 MiB."""
    return table(spark, sf_dir, "documents").where(F.col("n_chars") * 1024 > 1 << 20).select("doc_id")


@query("src_10", "SELECT page_id, strlen(html)::BIGINT AS length FROM pages WHERE strlen(html) > 1000")
def src_10(spark, sf_dir):
    """A listing of written files with keys read from names; small files do not count."""
    pages = table(spark, sf_dir, "pages").select(F.format_string("page_%d_masked.png", "page_id").alias("name"), F.col("html").alias("body"))
    found = files.listing(spark, files.write_texts(pages, f"{shared(spark)}/pages"))
    return found.where("length > 1000").select(F.regexp_extract("name", r"page_(\d+)_masked", 1).cast("long").alias("page_id"), "length")


@query("agg_21", "SELECT l_suppkey AS project, count(*)::BIGINT AS processes, round_even(sum(l_quantity) / 16, 1)::DOUBLE AS cpu_percent, round_even(sum(l_partkey * 1024) / 1048576, 1)::DOUBLE AS rss_mb FROM lineitem GROUP BY ALL")
def agg_21(spark, sf_dir):
    """Use of a project's processes: CPU as a share of 16 cores, resident memory in MB (order lines as processes)."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("project"))
    return p.agg(F.count("*").alias("processes"), R.round_even(F.sum("l_quantity") / 16, 1).alias("cpu_percent"), R.round_even(F.sum(F.col("l_partkey") * 1024) / 1048576, 1).alias("rss_mb"))


@query("top_02", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def top_02(spark, sf_dir):
    """The last 300 log events."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(300).select("event_id", "event_type")


@query("lim_01", "SELECT user_id, (n - 1) // 6 AS batch, count(*)::BIGINT AS size FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY ALL")
def lim_01(spark, sf_dir):
    """Batches of six in order."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", n.alias("n"))
    return e.groupBy("user_id", F.expr("bigint((n - 1) div 6)").alias("batch")).agg(F.count("*").alias("size"))


@query("lim_02", "SELECT p_size * 4 < 90 AS low, count(*)::BIGINT AS n, min(p_partkey) AS first FROM part GROUP BY ALL")
def lim_02(spark, sf_dir):
    """A batch apart by height."""
    return table(spark, sf_dir, "part").groupBy((F.col("p_size") * 4 < 90).alias("low")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("dat_01", "SELECT event_id, strftime(ts, '%H:%M:%S') AS hms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def dat_01(spark, sf_dir):
    """Stamps of log lines and checkpoints."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("hms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("dat_02", "SELECT user_id, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000::DOUBLE, 1)::DOUBLE AS elapsed FROM events GROUP BY ALL")
def dat_02(spark, sf_dir):
    """Elapsed seconds to one place."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(R.round_even((micros(F.max("ts")) - micros(F.min("ts"))) / 1000000.0, 1).alias("elapsed"))


@query("win_25", "WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) / 1000000::DOUBLE AS t, lag(epoch_us(ts) / 1000000::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT event_id, round(value / (t - p), 9)::DOUBLE AS rate FROM e WHERE t - p >= 0.5")
def win_25(spark, sf_dir):
    """Rate since the sample before, at least half a second ago."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    e = e.withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("event_id"))).where("dt >= 0.5")
    return e.select("event_id", F.round(F.col("value") / F.col("dt"), 9).alias("rate"))


_SCORE = "CASE WHEN contains(path, 'cuda12') THEN 40 WHEN contains(path, 'cuda') THEN 30 WHEN contains(path, 'vulkan') THEN 20 WHEN contains(path, 'avx2') THEN 10 ELSE 1 END"
_PATHS = "SELECT p_brand, 'bin-' || CASE p_size % 5 WHEN 0 THEN 'cuda12' WHEN 1 THEN 'cuda' WHEN 2 THEN 'vulkan' WHEN 3 THEN 'avx2' ELSE 'cpu' END || '-' || p_size || '.' || (p_partkey % 9) || '.' || (p_partkey % 4) AS path FROM part"


@query("con_06", f"WITH p AS ({_PATHS}), s AS (SELECT *, {_SCORE} AS score, string_split(regexp_extract(path, '(\\d+\\.\\d+\\.\\d+)$', 1), '.') AS v FROM p) SELECT p_brand, arg_max(path, (score, v[1]::INT, v[2]::INT, v[3]::INT))::VARCHAR AS best FROM s GROUP BY ALL")
def con_06(spark, sf_dir):
    """The best binary by backend, then by version."""
    p = table(spark, sf_dir, "part").selectExpr("p_brand", "concat('bin-', CASE p_size % 5 WHEN 0 THEN 'cuda12' WHEN 1 THEN 'cuda' WHEN 2 THEN 'vulkan' WHEN 3 THEN 'avx2' ELSE 'cpu' END, '-', p_size, '.', p_partkey % 9, '.', p_partkey % 4) AS path")
    score = F.expr(_SCORE)
    version = F.transform(F.split(F.regexp_extract("path", r"(\d+\.\d+\.\d+)$", 1), r"\."), lambda x: x.cast("int"))
    return p.groupBy("p_brand").agg(F.max_by("path", F.struct(score, version)).alias("best"))


@query("top_03", f"WITH p AS ({_PATHS}) SELECT p_brand, max({_SCORE})::INTEGER AS score FROM p GROUP BY ALL")
def top_03(spark, sf_dir):
    """The best backend's score."""
    return con_06(spark, sf_dir).withColumnRenamed("best", "path").select("p_brand", F.expr(_SCORE).alias("score"))


@query("con_03", "SELECT event_id, round(value, 2)::DOUBLE AS tok_s, event_id % 900 AS tokens FROM events WHERE event_type = 'view'")
def con_03(spark, sf_dir):
    """Speed and tokens read off the server's log lines."""
    line = F.concat(F.lit("eval time = 1.0 ms / "), (F.col("event_id") % 900).cast("string"), F.lit(" tokens ( 1 ms per token, "), F.format_string("%.2f", "value"), F.lit(" tokens per second)"))
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", line.alias("line"))
    return e.select("event_id", F.regexp_extract("line", r"([\d.]+) tokens per second", 1).cast("double").alias("tok_s"), F.regexp_extract("line", r"/ (\d+) tokens", 1).cast("long").alias("tokens"))


@query("api_01", f"WITH {_QUEUE} SELECT status, count(*)::BIGINT AS n FROM q GROUP BY ALL")
def api_01(spark, sf_dir):
    """Queue summary."""
    return queue_and_disk(spark, sf_dir)[0].groupBy("status").agg(F.count("*").alias("n"))


@query("api_02", f"WITH {_PHASE} SELECT count(*)::BIGINT AS books, sum(total)::BIGINT AS pages, sum(sliced)::BIGINT AS sliced, sum(omr)::BIGINT AS omr, sum(vlm)::BIGINT AS vlm FROM ph")
def api_02(spark, sf_dir):
    """Metrics over the queue."""
    return phases(spark, sf_dir).agg(F.count("*").alias("books"), *(F.sum(c).alias(c2) for c, c2 in (("total", "pages"), ("sliced", "sliced"), ("omr", "omr"), ("vlm", "vlm"))))


@query("api_09", "WITH e AS (SELECT o_custkey AS book, o_orderkey % 90 AS n FROM orders UNION ALL SELECT c_custkey, c_nationkey::BIGINT FROM customer) SELECT book, greatest(1, max(n))::BIGINT AS pages FROM e GROUP BY ALL")
def api_09(spark, sf_dir):
    """Pages of a book: the most that any evidence tells."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 90).alias("n"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"), F.col("c_nationkey").cast("long").alias("n"))
    return a.unionByName(b).groupBy("book").agg(F.greatest(F.lit(1), F.max("n")).cast("long").alias("pages"))
