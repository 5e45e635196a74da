"""Joining recognised notation into page texts, and pages into books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def resolve(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The best file for each wanted (page, stub): the name itself, then one that ends in it, then in its P-part.

    Equal ranks fall to the first name.  files: (page, name, body).  Joins are on page
    and on equality of derived suffix keys, never on a scan of all names.  A name gives its
    endings of the lengths that its page looks for only, and is never broadcast: the planner
    takes endings for no more than the names they come from.
    """
    tail = F.regexp_extract("stub", r"(P\d+.*)$", 1)
    keyed = wanted.select("page", "stub", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("stub").alias("key")), F.struct(F.lit(2).alias("rank"), F.col("stub").alias("key")), F.struct(F.lit(3).alias("rank"), F.nullif(tail, F.lit("")).alias("key")))).alias("k")).select("page", "stub", "k.rank", "k.key")
    lengths = keyed.where("key is not null").groupBy("page").agg(F.collect_set(F.length("key")).alias("lengths"))
    ends = F.transform(F.filter("lengths", lambda n: n.between(1, F.length("name"))), lambda n: F.right("name", n))
    suffixes = files.join(lengths.hint("merge"), "page").select("page", "name", "body", F.explode(ends).alias("key"))
    found = keyed.join(suffixes.hint("merge"), ["page", "key"]).where("rank > 1 or name = key")
    first = F.row_number().over(Window.partitionBy("page", "stub").orderBy("rank", "name"))
    return found.withColumn("nth", first).where("nth = 1").select("page", "stub", "name", "rank", "body")


def block(abc: Column, kern: Column, include_abc: bool = True, include_kern: bool = True) -> Column:
    """The fences of one stub; null where it has no usable notation."""
    parts = []
    if include_abc:
        parts.append(F.when((F.coalesce(X.strip(abc), F.lit("")) != "") & ~F.startswith(abc, F.lit(X.FAILED)), X.fenced("abc", abc)))
    if include_kern:
        parts.append(F.when(F.coalesce(X.strip(kern), F.lit("")) != "", X.fenced("kern", kern)))
    return F.nullif(F.concat_ws("\n\n", *parts), F.lit("")) if parts else F.lit(None).cast("string")


def inject(pages: DataFrame, notation: DataFrame, page_stubs: DataFrame) -> DataFrame:
    """(page, text): each stub tag becomes its notation; stubs of the page that no tag names follow at the end.

    pages: (page, text); notation: (page, stub, abc, kern), one row for a stub at most;
    page_stubs: (page, stub).  A text is cut at its tags, so every occurrence keeps its place.
    """
    parts = F.split("text", X.STUB.replace("(.*?)", ".*?"))
    cut = pages.select("page", F.posexplode(F.arrays_zip(parts.alias("piece"), F.regexp_extract_all("text", F.lit(X.STUB), 1).alias("stub"))).alias("i", "z")).select("page", "i", "z.piece", "z.stub")
    blocks = notation.select("page", "stub", block(F.col("abc"), F.col("kern")).alias("block"))
    put = F.when(F.col("stub").isNull(), "").when(F.col("block").isNotNull(), F.concat(F.lit("\n\n"), "block", F.lit("\n\n"))).otherwise(F.concat(F.lit("\n\n<!-- MUSIC_STUB_ID: "), "stub", F.lit(" (Notes not found, awaiting OMR) -->\n\n")))
    joined = cut.join(blocks, ["page", "stub"], "left").select("page", F.struct("i", F.concat("piece", put).alias("s")).alias("s"))
    text = joined.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["s"]), "").alias("text"))
    missing = page_stubs.select("page", "stub").distinct().join(cut.where("stub is not null").select("page", "stub").distinct(), ["page", "stub"], "left_anti")
    found = missing.join(blocks.where("block is not null"), ["page", "stub"])
    extra = found.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stub", "block"))), lambda s: s["block"]), "\n\n").alias("extra"))
    tail = F.when(F.col("extra").isNotNull(), F.concat(F.lit("\n\n<!-- RECOVERED_MUSIC_STUBS -->\n\n"), "extra", F.lit("\n"))).otherwise("")
    return text.join(extra, "page", "left").select("page", F.concat("text", tail).alias("text"))


def book(pages: DataFrame, markers: bool = True) -> DataFrame:
    """(book, text): pages in order, each behind its marker, apart by a rule. pages: (book, page, text)."""
    mark = F.format_string("<!-- PAGE %04d -->\n", "page") if markers else F.lit("")
    row = F.struct("page", F.concat(mark, F.coalesce("text", F.lit(""))).alias("s"))
    return pages.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["s"]), X.PAGE_BREAK).alias("text"))
