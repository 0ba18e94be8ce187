"""Scans over arrays as Column expressions, in n log n steps and not in n squared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each place the combination of the values up to and with it. `combine` is associative and
    `zero` its neutral value. Each pass doubles how far a place has looked back, so an array is
    rebuilt log2(n) times, where a fold that appends would copy it n times."""
    passes = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int")
    shifts = F.transform(F.sequence(F.lit(0), passes - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(
        shifts,
        values,
        lambda acc, shift: F.transform(acc, lambda x, i: combine(x, F.coalesce(F.get(acc, i - shift), zero))),
    )


def running_sum(values: Column) -> Column:
    """Running sums of an array of int."""
    return running(values, lambda x, before: x + before, F.lit(0))


def running_max(values: Column) -> Column:
    """Running maxima of an array of int of which none is negative."""
    return running(values, lambda x, before: F.greatest(x, before), F.lit(0))
