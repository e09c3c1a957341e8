"""Vector expressions: normalise, quantise, sign bits, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def given(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row, not for each element of a function over arrays."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prepared(v: Column, dimensions: int = 512) -> Column:
    """The first ``dimensions`` components, filled with zeros, scaled to length 1; zero stays zero."""
    cut = F.slice(v, 1, dimensions)
    filled = F.concat(F.transform(cut, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(dimensions) - F.size(cut))))
    both = F.struct(filled.alias("v"), norm(cut).alias("length"))
    return given(both, lambda b: F.when(b["length"] > 0, F.transform(b["v"], lambda x: x / b["length"])).otherwise(b["v"]))


def scale(v: Column) -> Column:
    """The step of the 8-bit form: the greatest magnitude over 127, or 1 for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top / 127).otherwise(F.lit(1.0))


def quantised(v: Column) -> Column:
    """8-bit components, rounded half away from zero."""
    both = F.struct(v.alias("v"), scale(v).alias("step"))
    return given(both, lambda b: F.transform(b["v"], lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") / b["step"]))).cast("tinyint")))


def signature(v: Column, first: int = 0) -> Column:
    """Sign bits of 64 components from ``first`` on: bit i is set where component i is positive."""
    part = F.slice(v, first + 1, 64)
    bits = F.transform(part, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.zip_with(bits, F.sequence(F.lit(0), F.lit(63)), lambda b, i: F.call_function("shiftleft", F.coalesce(b, F.lit(0).cast("long")), i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
