"""Operators across the instruments of one date: z-scores, neutral scores, rank correlation, turnover.

Each one partitions by date, so cross-sections of different dates are computed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelmill.functions.windows import percentile_rank

FLOOR = 1e-8
def by_date() -> WindowSpec:
    """The instruments of one date."""
    return Window.partitionBy("date")


def zscore(value: str) -> Column:
    """(x - mean) / population deviation of its date; the deviation is at least 1e-8."""
    return (F.col(value) - F.avg(value).over(by_date())) / F.greatest(F.stddev_pop(value).over(by_date()), F.lit(FLOOR))


def neutralised(df: DataFrame, value: str, group: str = "industry_group") -> DataFrame:
    """Add neutral: value less its group's mean (the date's mean for a group of one), as a z-score."""
    own = Window.partitionBy("date", group)
    df = df.withColumn("__d", F.col(value) - F.when(F.count(F.lit(1)).over(own) >= 2, F.avg(value).over(own)).otherwise(F.avg(value).over(by_date())))
    return df.withColumn("neutral", zscore("__d")).drop("__d")


def rank_ic(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation by date from moments of average-tie ranks; dates with fewer than 3 rows or no spread are left out."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("date", percentile_rank(x, "date").alias("a"), percentile_rank(y, "date").alias("b"))
    m = ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    return m.where("n >= 3 AND va > 1e-12 AND vb > 1e-12").select("date", "n", (F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).alias("ic"))


def ic_summary(ic: DataFrame, recent: int = 26) -> DataFrame:
    """Mean, annualised ratio, t statistic, positive share and the same mean over the last dates. One row a factor."""
    last = ic.withColumn("rn", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("date"))))
    mean, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count(F.lit(1))
    return last.groupBy("factor").agg(
        n.alias("dates"),
        F.round(mean, 6).alias("ic_mean"),
        F.round(F.try_divide(mean, sd) * F.sqrt(F.lit(52.0)), 6).alias("ic_ir"),
        F.round(F.try_divide(mean, sd) * F.sqrt(n.cast("double")), 6).alias("ic_t"),
        F.round(F.avg((F.col("ic") > 0).cast("double")), 6).alias("positive"),
        F.round(F.avg(F.when(F.col("rn") <= recent, F.col("ic"))), 6).alias("recent_mean"),
    )


def top_quartile_turnover(df: DataFrame, value: str, share: float = 0.25, by: list[str] | None = None) -> DataFrame:
    """Half the sum of absolute weight changes of the equal-weight top share, by date (the first date has none); by: columns of separate panels."""
    by = by or []
    day = Window.partitionBy(*by, "date")
    rank = F.row_number().over(day.orderBy(F.desc(value), "code"))
    held = df.withColumn("rk", rank).withColumn("k", F.ceil(F.count(F.lit(1)).over(day) * share)).where("rk <= k").select(*by, "date", "code", (1 / F.col("k")).alias("w"))
    number = df.select(*by, "date").distinct().withColumn("t", F.row_number().over(Window.partitionBy(*by).orderBy("date")))  # one row a date
    held = held.join(number, [*by, "date"]).select(*by, "code", "w", "t")
    # A weight acts at its own date (entering) and, negated, at the next one (leaving); their sum is the change.
    moved = held.unionByName(held.select(*by, "code", (-F.col("w")).alias("w"), (F.col("t") + 1).alias("t")))
    change = moved.groupBy(*by, "t", "code").agg(F.sum("w").alias("d")).groupBy(*by, "t").agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    return number.join(change, [*by, "t"]).where("t > 1").select(*by, "date", "turnover")


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """Add q: the step-up adjusted p-values. One row a tested factor."""
    n, up = F.count(F.lit(1)).over(Window.partitionBy()), Window.orderBy(p, "factor")
    df = df.withColumn("__rk", F.row_number().over(up)).withColumn("__raw", F.col(p) * n / F.col("__rk"))
    return df.withColumn("q", F.least(F.lit(1.0), F.min("__raw").over(Window.orderBy(F.desc("__rk"))))).drop("__rk", "__raw")
