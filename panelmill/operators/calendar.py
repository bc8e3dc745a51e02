"""Periods, confirmation and session arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_of(unit: str, date: str = "date") -> Column:
    """First day of the week or month."""
    return F.date_trunc(unit, F.col(date).cast("timestamp")).cast("date")


def roll_up(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a period: date last, open first, high max, low min, close last, volume sum; incomplete periods included."""
    return (
        bars.groupBy("code", period_of(unit).alias("period"))
        .agg(
            F.max("date").alias("date"),
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def confirmed(bars: DataFrame, calendar: DataFrame, unit: str, as_of: str) -> DataFrame:
    """Roll-up of those periods whose last session is not after as_of."""
    ends = calendar.groupBy(period_of(unit).alias("period")).agg(F.max("date").alias("period_end")).where(F.col("period_end") <= F.lit(as_of).cast("date"))
    return roll_up(bars.where(F.col("date") <= F.lit(as_of).cast("date")), unit).join(ends, "period")


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays after start up to and including end; 999 if there is no start. Closed form, no sequence."""
    ordinal = lambda d: F.datediff(d, F.lit("1970-01-05").cast("date"))  # a Monday
    upto = lambda d: F.floor(ordinal(d) / 7) * 5 + F.least(F.pmod(ordinal(d), F.lit(7)) + 1, F.lit(5))
    return F.when(start.isNull() | end.isNull(), 999).otherwise(F.greatest(upto(end) - upto(start), F.lit(0))).cast("bigint")


def session_number(calendar: DataFrame) -> DataFrame:
    """Sessions with their running number. The calendar has one row a day, whatever the panel's size."""
    return calendar.withColumn("session", F.row_number().over(Window.orderBy("date")).cast("bigint"))


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """For each (code, date) of left the last value of right at or before that date.

    Union and one window over (code, date): a shuffle on code, without a range join.
    """
    probe = left.select("code", "date", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("probe"))
    rows = right.select("code", "date", value, F.lit(0).alias("probe")).unionByName(probe)
    w = Window.partitionBy("code").orderBy("date", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("probe = 1").drop("probe")
