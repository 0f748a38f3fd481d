"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def truncated(a: Column, dimension: int) -> Column:
    """The first ``dimension`` components, scaled to length one; a zero or non-finite length is an error."""
    head = F.transform(F.slice(a, 1, dimension), lambda x: x.cast("double"))
    length = norm(head)
    bad = F.isnan(length) | (length == 0) | (length == float("inf"))
    return F.when(bad, F.raise_error(F.lit("vector has no usable length")).cast("array<double>")).otherwise(F.transform(head, lambda x: x / length))


def checked(a: Column, dimension: int) -> Column:
    """``a``, or an error unless it has ``dimension`` components."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.lit(f"vector is not of dimension {dimension}")).cast("array<double>"))


def comparable(a: Column, b: Column, least: float = 0.99999) -> Column:
    """Whether two encodings of a text agree."""
    return cosine(a, b) >= least


def pooled(states: Column, mask: Column, kind: str) -> Column:
    """Token states (an array of vectors) to one vector: that of the first token inside the mask (cls), of the last
    one (last), or the mean of all (mean)."""
    inside = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"]), lambda x: x["s"])
    if kind != "mean":
        return F.element_at(inside, 1 if kind == "cls" else -1)
    zero = F.transform(F.element_at(inside, 1), lambda _: F.lit(0.0))
    return F.aggregate(inside, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b), lambda s: F.transform(s, lambda a: a / F.size(inside)))
