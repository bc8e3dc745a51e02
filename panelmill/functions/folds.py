"""Recursive smoothing of ordered arrays.

An exponential mean depends on the whole prefix, so it is a fold: the history of an instrument is
collected once, ordered, and folded by the JVM's aggregate function. One row then holds one
instrument's history, which is bounded by the length of the calendar, not by the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histories(bars: DataFrame, *columns: str) -> DataFrame:
    """One row per code with h, its rows in order of date."""
    return bars.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("date", *columns))).alias("h"))


def values(column: str) -> Column:
    return F.transform("h", lambda x: x[column])


def ewm(array: Column, alpha: float) -> Column:
    """The exponentially weighted means of an array, seeded by its first element."""
    start = F.slice(array, 1, 1)
    return F.aggregate(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) * (1 - alpha) + x * alpha)))


def ewm_last(array: Column, alpha: float) -> Column:
    """Only the last exponentially weighted mean; constant memory."""
    return F.aggregate(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), F.element_at(array, 1), lambda acc, x: acc * (1 - alpha) + x * alpha)


def differences(array: Column) -> Column:
    """x[i] - x[i-1], with 0 for the first."""
    return F.transform(array, lambda x, i: F.when(i == 0, 0.0).otherwise(x - F.get(array, i - 1)))
