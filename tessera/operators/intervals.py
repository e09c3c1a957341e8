"""Joins of intervals and points inside an equal key, dealt by pieces of the axis as well as by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _piece(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("long")


def overlapping(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], of_left: tuple[str, str], of_right: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals (first, last) share a point; column names of the two sides differ.

    An interval goes to every piece of ``width`` that it touches, and a pair is made in the first piece that both
    touch, so a key with very many rows is dealt over the axis and no pair comes twice. A width of about the usual
    length of an interval keeps the copies few. Rows with a null key or end have no partner.
    """
    touched = lambda f, t: F.explode(F.sequence(_piece(F.col(f), width), _piece(F.col(t), width)))
    a = left.where(F.col(of_left[0]) <= F.col(of_left[1])).withColumn("__a", touched(*of_left))
    b = right.where(F.col(of_right[0]) <= F.col(of_right[1])).withColumn("__b", touched(*of_right))
    on = [F.col(x) == F.col(y) for x, y in keys] + [F.col("__a") == F.col("__b")]
    on += [F.col(of_left[0]) <= F.col(of_right[1]), F.col(of_left[1]) >= F.col(of_right[0])]
    on += [F.col("__a") == F.greatest(_piece(F.col(of_left[0]), width), _piece(F.col(of_right[0]), width))]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return a.join(b, condition).drop("__a", "__b")
