"""Numeric expressions with nulls for what has no value, under ANSI mode too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column, kind: str = "double") -> Column:
    """Text or number as a double; what isn't one, NaN included, is null."""
    n = c.try_cast(kind)
    return F.when(~F.isnan(n), n)


def ratio_less_one(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) - 1


def at_least(k: int, c: Column, value: Column, frame) -> Column:
    """``value`` over ``frame`` where the frame has ``k`` values of ``c`` that aren't null."""
    return F.when(F.count(c).over(frame) >= k, value.over(frame))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate, over rows that have both; null for a constant series."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
