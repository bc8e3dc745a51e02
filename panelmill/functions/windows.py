"""Ordered analytics of a panel as window columns over (code, date).

All windows share one partitioning and order, so Spark evaluates them behind a single shuffle and sort.
Rows without enough history give null.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def by_code() -> WindowSpec:
    """The bars of an instrument in order of date."""
    return Window.partitionBy("code").orderBy("date")


def last_n(n: int, until: int = 0):
    """The n rows that end until rows before the current one."""
    return by_code().rowsBetween(-(n - 1) - until, -until)


def full(value: Column, n: int, row: str = "n") -> Column:
    """value, where the instrument has at least n rows so far."""
    return F.when(F.col(row) >= n, value)


def sma(column: str, n: int) -> Column:
    return full(F.avg(column).over(last_n(n)), n)


def lag(column: str, n: int) -> Column:
    return F.lag(column, n).over(by_code())


def true_range() -> Column:
    before = lag("close", 1)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def log_return(column: str, n: int) -> Column:
    """ln of the ratio to n rows before; 0 without enough history or with a price that is not positive."""
    before = lag(column, n)
    return F.when((before > 0) & (F.col(column) > 0), F.ln(F.col(column) / before)).otherwise(0.0)


def percentile_rank(column: str, *by: str) -> Column:
    """Average-tie percentile rank within a group."""
    group = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, column)
    return (F.rank().over(group.orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(F.lit(1)).over(group)
