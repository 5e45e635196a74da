"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``<s>[INST]role[/INST]text</s>``.  Control strings inside roles and
texts are escaped reversibly: a backslash is doubled, and a backslash is put behind the
first character of each control string (``</s>`` becomes ``<\\/s>``), so none of them can
stand in a formatted turn but where the template put it.

A conversation is formatted once.  ``expand`` explodes every assistant turn into an example of
its own, a row each: its context, which is all that stands before its reply, then the reply, and
only the reply is under the loss mask.  Contexts are written out, so the expansion is quadratic in the
turns of a conversation; only spans are exploded, so one context at a time is held, not all of them.
``digest`` reads the loss off the examples' texts by their masks, in their order, and the turns off
the formatted text.

A conversation is one string, and so a row: its digest is one of that string.

Defined results: turns are ordered by (turn, role, text), null first; null role or text
reads as ''; the rows of a null conv_id are one conversation; a conversation without an
assistant turn has no example and an empty loss; repeated rows are turns of their own;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, CLOSE, ROLE, BODY = "<s>", "</s>", "[INST]", "[/INST]"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=/?s>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, target_starts, target_ends (code points of each reply, from 0, without </s>)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    said = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    written = said.withColumns({"head": F.concat(F.lit(OPEN + ROLE), escape(F.col("role")), F.lit(BODY)), "body": escape(F.col("text"))})
    size = F.length("head") + F.length("body") + len(CLOSE)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.sum(size).over(order) - len(CLOSE)).cast("long")
    placed = written.withColumn("end", end).withColumn("start", F.col("end") - F.length("body"))  # a turn ends behind all before it
    parts = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("end", "start", (F.col("role") == TARGET_ROLE).alias("target"), F.concat("head", "body", F.lit(CLOSE)).alias("piece")))).alias("p"))
    spans = F.filter("p", lambda p: p["target"])
    parts = parts.select("conv_id", F.array_join("p.piece", "").alias("formatted"), spans.alias("spans"))
    return parts.select("conv_id", "formatted", F.col("spans.start").alias("target_starts"), F.col("spans.end").alias("target_ends"))


def expand(formatted: DataFrame, materialise: bool = True, whole: bool = False) -> DataFrame:
    """One row for each assistant turn: conv_id, example (from 0), target_start, target_end, target, context (as formatted).

    The example's text is context + target, its context formatted[0, target_start), its loss mask
    [target_start, target_end).  materialise=False: contexts stay spans, without their column.
    whole: a row of example -1 for each conversation holds its formatted text as target, so
    that both travel in one pass.
    """
    spans = F.transform(
        F.arrays_zip("target_starts", "target_ends"),
        lambda s, k: F.struct(k.cast("long").alias("example"), s["target_starts"].alias("target_start"), s["target_ends"].alias("target_end")),
    )
    if whole:
        size = F.length("formatted").cast("long")
        spans = F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("example"), F.lit(0).cast("long").alias("target_start"), size.alias("target_end"))), spans)
    rows = formatted.select("conv_id", "formatted", F.explode(spans).alias("r")).select("conv_id", "formatted", "r.*")
    parts = [masked(F.col("formatted")).alias("target")]
    if materialise:
        parts.append(F.substr("formatted", F.lit(1), F.col("target_start").cast("int")).alias("context"))
    return rows.select("conv_id", "example", "target_start", "target_end", *parts)


def masked(text: Column) -> Column:
    """What stands under the loss mask of an example's row."""
    return F.substr(text, (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int"))


def turns_of(formatted: Column) -> Column:
    """[(role, text)] as they stand in a formatted conversation."""
    pieces = F.filter(F.split(formatted, F.lit(CLOSE), -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(OPEN + ROLE) + 1, 2**30), BODY, 1)).alias("role"), unescape(F.substring_index(p, BODY, -1)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the examples."""
    rows = expand(formatted, whole=True)  # still partitioned by conversation
    own = masked(F.concat("context", "target"))
    read = rows.select("conv_id", F.when(F.col("example") < 0, own).alias("formatted"), F.when(F.col("example") >= 0, F.struct("example", unescape(own).alias("text"))).alias("reply"))
    back = read.groupBy("conv_id").agg(F.max("formatted").alias("formatted"), F.sort_array(F.collect_list("reply")).alias("replies"))
    back = back.select("conv_id", turns_of(F.col("formatted")).alias("turns"), F.array_join("replies.text", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
