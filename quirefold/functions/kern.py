"""Scalar rules of kern tokens and box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Standard durations in quarter beats, in the order that ties prefer.
STANDARD_BEATS = (0.125, 0.25, 0.375, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0)


def beats(token: Column) -> Column:
    """Quarter beats of the first duration in a token; null where there is none, 4 for 0."""
    number = F.regexp_extract(token, r"(\d+)(\.*)", 1)
    dots = F.length(F.regexp_extract(token, r"(\d+)(\.*)", 2))
    value = number.cast("double")
    dotted = F.lit(4.0) / value * (F.lit(2.0) - F.pow(F.lit(0.5), dots))
    return F.when(token.isNull() | (token == ".") | (number == ""), F.lit(None).cast("double")).when(value == 0, F.lit(4.0)).otherwise(dotted)


def pitch(token: Column) -> Column:
    """A token without its durations."""
    return F.regexp_replace(token, r"\d+\.*", "")


def letters(token: Column) -> Column:
    """The sorted pitch letters (and r) of a token."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(token), F.lit("[a-gr]"), 0)), "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def nearest_standard(value: Column) -> Column:
    """The standard duration nearest to a value; the first of equals."""
    options = F.array(*(F.struct(F.abs(value - s).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(STANDARD_BEATS)))
    return F.array_min(options)["s"]


def expected_beats(signature: Column) -> Column:
    """num/den of a time signature in quarter beats."""
    parts = F.split(signature, "/")
    num, den = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when(den != 0, num.cast("double") / den.cast("double") * 4.0)


def spines_valid(lines: Column) -> Column:
    """Whether every line of an array has as many columns as the lines before leave active.

    One pass with the number of active columns as state: a split adds a column, a run of
    merges leaves one.  The first line sets the number; some line has to be a header.
    """
    rows = F.transform(F.filter(lines, lambda x: (strip(x) != "") & ~F.startswith(x, F.lit("!"))), lambda x: F.split(strip(x), "\t"))

    def after(t):
        merges = F.aggregate(t, F.struct(F.lit(0).alias("n"), F.lit(False).alias("in_run")), lambda s, x: F.struct((s["n"] + F.when(x == "*^", 2).when((x == "*v") & s["in_run"], 0).otherwise(1)).alias("n"), (x == "*v").alias("in_run")))
        return F.greatest(F.lit(1), merges["n"])

    def step(s, t):
        moves = F.exists(t, lambda x: x.isin("*^", "*v"))
        fine = (F.size(t) == s["width"]) & (~moves | F.forall(t, lambda x: F.startswith(x, F.lit("*"))))
        return F.struct(F.when(moves, after(t)).otherwise(s["width"]).alias("width"), (s["ok"] & fine).alias("ok"))

    first = F.struct(F.size(rows[0]).alias("width"), F.lit(True).alias("ok"))
    result = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), first, step)["ok"]
    headed = F.exists(rows, lambda t: F.startswith(t[0], F.lit("**")))
    return F.when(F.size(rows) == 0, F.lit(False)).otherwise(F.coalesce(headed & result, F.lit(False)))
