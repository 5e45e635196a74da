"""One-dimensional profiles (ink by row or column) as rows (key, pos, v): islands, peaks, runs, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order():
    return Window.partitionBy("key").orderBy("pos")


def so_far():
    return order().rowsBetween(Window.unboundedPreceding, 0)


def islands(points: DataFrame, gap: float) -> DataFrame:
    """(key, island, first, last, n, mean): positions, a new island where the gap to the one before is over `gap`."""
    new = F.coalesce(F.col("pos") - F.lag("pos").over(order()) > gap, F.lit(True)).cast("int")
    marked = points.withColumn("new", new).withColumn("island", F.sum("new").over(so_far()))
    return marked.groupBy("key", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"), F.avg("pos").alias("mean"))


def runs(profile: DataFrame, flag: Column) -> DataFrame:
    """(key, start, end, on, n): maximal runs of an equal flag."""
    x = profile.withColumn("on", flag)
    x = x.withColumn("new", (~F.col("on").eqNullSafe(F.lag("on").over(order()))).cast("int")).withColumn("run", F.sum("new").over(so_far()))
    return x.groupBy("key", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.first("on").alias("on"), F.count("*").alias("n"))


def peaks(profile: DataFrame) -> DataFrame:
    """Points above the one before and not below the one behind."""
    x = profile.withColumns({"before": F.lag("v").over(order()), "behind": F.lead("v").over(order())})
    return x.where((F.col("v") > F.col("before")) & (F.col("v") >= F.col("behind"))).drop("before", "behind")


def valleys(profile: DataFrame) -> DataFrame:
    """Points not above either neighbour."""
    x = profile.withColumns({"before": F.lag("v").over(order()), "behind": F.lead("v").over(order())})
    return x.where((F.col("v") <= F.col("before")) & (F.col("v") <= F.col("behind"))).drop("before", "behind")


def kept_apart(points: DataFrame, least: int, by: Column | None = None) -> DataFrame:
    """(key, kept): positions taken in order (of `by` descending, or of place), each `least` from all taken so far.

    What is taken decides what follows, so it is one pass over a key's array.
    """
    rank = F.struct((-by if by is not None else F.col("pos")).alias("o"), "pos")
    taken = F.aggregate(F.array_sort(F.collect_list(rank)), F.array().cast("array<long>"), lambda a, x: F.when(F.exists(a, lambda p: F.abs(p - x["pos"]) < least), a).otherwise(F.concat(a, F.array(x["pos"].cast("long")))))
    return points.groupBy("key").agg(F.array_sort(taken).alias("kept"))


def ema(profile: DataFrame, weight: float = 0.25) -> DataFrame:
    """(key, last): exponential tracking (1 - weight) * state + weight * value, in order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    tracked = F.aggregate(values, F.lit(None).cast("double"), lambda s, v: F.coalesce((1 - weight) * s + weight * v, v))
    return profile.groupBy("key").agg(tracked.alias("last"))


def box_smooth(profile: DataFrame, half: int = 7) -> DataFrame:
    return profile.withColumn("v", F.avg("v").over(order().rowsBetween(-half, half)))


def five_lines(lines: DataFrame, least: float = 5, most: float = 24, spread: float = 0.15) -> DataFrame:
    """(key, pos, spacing): places where a line and the next four stand evenly, and the sixth does not go on evenly."""
    ahead = [F.lead("pos", i).over(order()) for i in range(1, 7)]
    x = lines.withColumn("p", F.array(F.col("pos"), *ahead)).where(F.col("p")[4].isNotNull())
    gaps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("p")[i + 1] - F.col("p")[i]).cast("double"))
    x = x.withColumn("d", gaps)
    mean = F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / 4
    x = x.withColumn("spacing", mean)
    even = F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, v: a + (v - F.col("spacing")) * (v - F.col("spacing"))) / 4) / F.col("spacing") <= spread
    fifth = F.col("p")[5] - F.col("p")[4]
    grid = F.coalesce(F.abs(fifth - F.col("spacing")) <= 0.3 * F.col("spacing"), F.lit(False))
    return x.where(F.col("spacing").between(least, most) & even & ~grid).select("key", "pos", "spacing")


def trace(profile: DataFrame, ink: Column, anchor: Column, gap: int = 35) -> DataFrame:
    """(key, left, right): the island of inked positions (gaps up to `gap`) that holds the anchor."""
    found = islands(profile.where(ink), gap)
    return found.where((F.col("first") <= anchor) & (anchor <= F.col("last"))).select("key", F.col("first").alias("left"), F.col("last").alias("right"))


def densest(profile: DataFrame, ink: Column, size: int) -> DataFrame:
    """(key, pos, share): the window of `size` positions that is covered most, the first of equals."""
    frame = order().rowsBetween(0, size - 1)
    x = profile.withColumn("share", F.avg(ink.cast("int")).over(frame)).withColumn("n", F.count("*").over(frame)).where(F.col("n") == size)
    best = x.groupBy("key").agg(F.max_by(F.struct("pos", "share"), F.struct("share", -F.col("pos"))).alias("b"))
    return best.select("key", "b.pos", "b.share")
