"""Sequence similarity: the ratio of matching characters, and lossless upper bounds for it.

The ratio depends on argument order, so call sites state which side comes first. The bounds are
plain expressions: a join condition or filter on `length_bound` and `multiset_bound` spares pairs
that cannot reach a threshold before any Python runs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str, autojunk: bool = False) -> float:
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


@F.pandas_udf(DoubleType())
def ratio_column(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio(a, b); equal texts are 1, one empty text 0, without running the matcher."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else 0.0 if not x or not y else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def length_bound(a: Column, b: Column) -> Column:
    """2 * min / sum of the lengths: no ratio is above it."""
    return 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def multiset_bound(a: Column, b: Column) -> Column:
    """Twice the shared characters, with multiplicity, over both lengths."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    letters = F.array_intersect(F.split(a, ""), F.split(b, ""))
    shared = F.aggregate(
        F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)).cast("int")
    )
    return 2 * shared / F.greatest(F.length(a) + F.length(b), F.lit(1))
