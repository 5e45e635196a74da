"""Notation texts from one form to another: attempts in order, the first that gives something counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FAILED, strip
from ..sources.stages import Stage

# Headers of written scores.
OWN_TITLES = ("T:Music21 Fragment", "C:Music21")
BARE, VOICE = "M:4/4\nL:1/4\nK:C\nz4 |", "L:1/4\nM:none\nI:linebreak $\nK:C\nV:1 treble\nV:1\n"
CLASSES = ("grand_staff", "system")


def _titled(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("T:"), title, F.lit("\n"))).otherwise("")


def bare_score(title: Column) -> Column:
    """A bar of rest, where a converter gave an empty text."""
    return F.concat(F.lit("X:1\n"), _titled(title), F.lit(BARE))


def event_score(events: Column, title: Column, most: int = 32) -> Column:
    """One voice of the first notes and rests, where no converter took the score."""
    body = F.array_join(F.slice(F.coalesce(events, F.array().cast("array<string>")), 1, most), " ")
    return F.concat(F.lit("X:1\n"), _titled(title), F.lit(VOICE), F.when(body == "", "z4").otherwise(body), F.lit(" |"))


def clean_score(abc: Column, title: Column) -> Column:
    """Without the converter's own titles; with a title given, every title is that one, and one stands behind the first X: line."""
    named = F.coalesce(title, F.lit("")) != ""
    own = F.concat(F.lit("T:"), title)
    lines = F.filter(F.split(strip(abc), r"\r?\n"), lambda x: ~(x.startswith(OWN_TITLES[0]) | x.startswith(OWN_TITLES[1])))
    lines = F.transform(lines, lambda x: F.when(named & x.startswith("T:"), own).otherwise(x))
    head = F.array_position(F.transform(lines, lambda x: x.startswith("X:")), F.lit(True)).cast("int")
    lacks = named & ~F.exists(lines, lambda x: x.startswith("T:")) & (head > 0)
    return F.array_join(F.when(lacks, F.concat(F.slice(lines, F.lit(1), head), F.array(own), F.slice(lines, head + 1, F.size(lines)))).otherwise(lines), "\n")


def attempts(rows: DataFrame, stages: Sequence[Stage], column: str) -> DataFrame:
    """rows with ``column`` from the first stage that succeeds, and ``attempt``: its place, null where none did.

    Each stage is asked only about rows that all before it failed. Keys are unique in rows.
    """
    key, todo, found = stages[0].key, rows, None
    for at, stage in enumerate(stages):
        got = stage.apply(todo).select(key, F.col(column).alias("_out"), (F.col("status") == "success").alias("_ok"))
        here = got.where("_ok").select(key, "_out", F.lit(at).alias("_at"))
        found = here if found is None else found.unionByName(here)
        todo = todo.join(got.where("NOT _ok").select(key), key, "left_semi")
    return rows.join(found, key, "left").select(*rows.columns, F.col("_out").alias(column), F.col("_at").alias("attempt"))


def to_abc(rows: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """(stub, title, kern, events) to (stub, abc, attempt): converters in order, then a score from the events alone."""
    tried = attempts(rows, stages, "abc")
    abc = F.when(F.col("attempt").isNull(), event_score(F.col("events"), F.col("title")))
    abc = abc.otherwise(clean_score(F.when(F.coalesce("abc", F.lit("")) == "", bare_score(F.col("title"))).otherwise(F.col("abc")), F.col("title")))
    return tried.select("stub", abc.alias("abc"), "attempt")


def flat_svg(svg: Column) -> Column:
    """One svg root: the inner one of an engraver becomes a group, its view box the root's where that has none."""
    inner = r"<svg\s+([^>]*class=[\"']definition-scale[\"'][^>]*)>"
    attrs = F.regexp_extract(svg, inner, 1)
    box = F.regexp_extract(attrs, r"viewBox=[\"']([^\"']+)[\"']", 1)
    out = F.regexp_replace(F.regexp_replace(svg, inner, r"<g $1>"), r"</svg>(\s*</svg>\s*)$", r"</g>$1")
    boxed = F.regexp_replace(out, F.lit(r"(?s)\A(.*?)<svg\s+"), F.concat(F.lit('$1<svg viewBox="'), box, F.lit('" ')))
    wants = (box != "") & ~F.substring(out, 1, 200).contains("viewBox")
    return F.when(svg.rlike(inner), F.when(wants, boxed).otherwise(out)).otherwise(svg)


def engrave(rows: DataFrame, stage: Stage) -> DataFrame:
    """(stub, kern, valid) to (stub, svg): empty for failed, empty or uneven texts and wherever the engraver fails."""
    fit = rows.where((F.coalesce("kern", F.lit("")) != "") & ~F.col("kern").startswith(FAILED[:5]) & F.col("valid"))
    drawn = stage.apply(fit.select("stub", "kern")).where("status = 'success'").select("stub", flat_svg(F.col("svg")).alias("svg"))
    return rows.select("stub").join(drawn, "stub", "left").select("stub", F.coalesce("svg", F.lit("")).alias("svg"))


def backfill(rows: DataFrame, stage: Stage) -> DataFrame:
    """(stub, abc, kern) with a kern text from abc where none is stored (null); empty where there is no abc or it fails."""
    todo = rows.where(F.col("kern").isNull() & (strip(F.coalesce("abc", F.lit(""))) != "")).select("stub", strip(F.col("abc")).alias("abc"))
    made = stage.apply(todo).where("status = 'success'").select("stub", F.col("kern").alias("_made"))
    kern = F.coalesce(strip(F.col("kern")), "_made", F.lit(""))
    return rows.join(made, "stub", "left").select("stub", "abc", kern.alias("kern"), F.col("_made").isNotNull().alias("made"))


def transcribe_live(requests: DataFrame, crops: DataFrame, stage: Stage) -> DataFrame:
    """(page_id, stub) to one answer each: (page_id, stub, status, message, abc, kern, model_used), through a recogniser.

    crops: (book, stub, deskewed, data), unique by the first three; a deskewed crop is taken before a raw one. A page id without its
    mark, a crop that is not there, one without data and a recogniser that fails are errors with their message.
    """
    book = F.when(F.col("page_id").contains("__page_"), F.split_part("page_id", F.lit("__page_"), F.lit(1)))
    best = crops.groupBy("book", "stub").agg(F.max_by("data", F.col("deskewed").cast("int")).alias("data"), F.lit(True).alias("found"))
    asked = requests.withColumn("book", book).join(best, ["book", "stub"], "left").withColumn("ask", F.concat_ws("/", "page_id", "stub"))
    kind = F.when(F.col("stub").contains(CLASSES[0]), CLASSES[0]).when(F.col("stub").contains(CLASSES[1]), CLASSES[1]).otherwise("staff")
    got = stage.apply(asked.where("data IS NOT NULL").select("ask", "stub", kind.alias("kind"), "data").dropDuplicates(["ask"]))
    out = asked.join(got, "ask", "left")
    message = (
        F.when(F.col("book").isNull(), F.concat(F.lit("Invalid page_id: "), F.coalesce("page_id", F.lit(""))))
        .when(F.col("found").isNull(), F.concat(F.lit("Crop file not found: "), "stub"))
        .when(F.col("data").isNull(), F.lit("Failed to read crop image"))
        .when(F.col("status") != "success", F.col("error"))
    )
    fine = message.isNull()
    text = lambda c: F.when(fine, F.coalesce(c, F.lit(""))).alias(c if c != "raw_kern" else "kern")
    return out.select("page_id", "stub", F.when(fine, "success").otherwise("error").alias("status"), message.alias("message"), text("abc"), text("raw_kern"), text("model_used"))
