"""Rounding of doubles as the SQL beside the queries has it: on the scaled double, where Spark's own rounds the shortest decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled(x: Column, places: int, whole) -> Column:
    x = x.cast("double")
    y = x * F.lit(10.0**places)
    return F.when(F.abs(y) == float("inf"), x).otherwise(whole(y) / F.lit(10.0**places))


def round_half(x: Column, places: int) -> Column:
    """round(x, places): halves away from zero."""

    def whole(y):
        near = F.rint(F.abs(y))
        return F.signum(y) * F.when(F.abs(y) - near == 0.5, near + 1).otherwise(near)

    return _scaled(x, places, whole)


def round_even(x: Column, places: int) -> Column:
    """round_even(x, places): halves to the even neighbour."""
    return _scaled(x, places, F.rint)
