"""Scalar expressions that operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """A timestamp (with or without zone, the session's zone being UTC) as whole epoch seconds, fractions cut off."""
    return F.unix_timestamp(ts).cast("long")


def epoch_of_text(text: Column) -> Column:
    """A text `2014-09-13 23:59:59` in the session's zone as epoch seconds; null where it is none."""
    return epoch(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def normalized(x: Column, lo: Column, hi: Column) -> Column:
    """(ln(1 + x) - lo) / (hi - lo); 0 where the bounds are equal. Values beyond the bounds stay beyond 0 and 1."""
    return F.coalesce(F.try_divide(F.log1p(x) - lo, hi - lo), F.lit(0.0))


def denormalized(z: Column, lo: Column, hi: Column) -> Column:
    """The x whose `normalized` is z."""
    return F.expm1(z * (hi - lo) + lo)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: the optimizer copies what a column stands for to each of its uses, into loops over elements too."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; null where their lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(vec: Column) -> Column:
    """Euclidean length, 1 for vectors of zeros."""
    return bound(F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n == 0, 1.0).otherwise(n))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def positive_set(vec: Column) -> Column:
    """Positions of a vector's positive coordinates."""
    return F.filter(F.transform(vec, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def sided(condition: Column) -> Column:
    """A condition `a = b` in lower case with its sides in order, as `a=b`."""
    return F.array_join(F.array_sort(F.transform(F.split(F.lower(condition), "="), lambda x: F.trim(x))), "=")


def quoted(value: Column) -> Column:
    """A string as a SQL literal."""
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
