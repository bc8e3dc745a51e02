"""Research metrics of factors: significance, decay, holdouts, registries, live verdicts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from panelmill.functions.windows import percentile_rank
from panelmill.operators import crosssection as S

HORIZONS = (5, 10, 20)


@pandas_udf(DoubleType())
def two_sided_normal(t: pd.Series) -> pd.Series:
    """Chance of a normal deviate at least as far out. Spark has no error function; the column has one row a factor."""
    return t.map(lambda x: math.erfc(abs(x) / math.sqrt(2.0)))


def sign_tail(n: Column, wins: Column) -> Column:
    """Chance of at least that many wins in n fair trials: the terms of the binomial sum follow one from the other."""
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("total"))

    def step(acc, i):
        return F.struct((acc["term"] * (n - i) / (i + 1)).alias("term"), (acc["total"] + F.when(i >= wins, acc["term"]).otherwise(0.0)).alias("total"))

    return F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0).cast("bigint"), n), start, step, lambda acc: acc["total"]))


#: Reasons against a factor and their conditions.
REASONS = [
    ("INSUFFICIENT_IC_HISTORY", "observations < 8"),
    ("NEGATIVE_RECENT_IC", "recent_mean < -0.01"),
    ("RECENT_IC_WEAK", "recent_mean >= -0.01 AND recent_mean < 0.01"),
    ("RECENT_IR_WEAK", "recent_ir < 0.15"),
    ("FAST_DECAY", "decay_ratio < 0.20"),
    ("EXCESSIVE_TURNOVER", "turnover > 0.85"),
    ("IC_SIGN_FLIP", "ic_mean * recent_mean < 0 AND abs(ic_mean) >= 0.01 AND abs(recent_mean) >= 0.01"),
]
HARD = ("NEGATIVE_RECENT_IC", "EXCESSIVE_TURNOVER", "IC_SIGN_FLIP")


def reasons(rules: list[tuple[str, str]]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.expr(condition), name) for name, condition in rules]))


def factor_metrics(ics: DataFrame, turnover: DataFrame) -> DataFrame:
    """One row a factor: mean, ratio, t, sign share, p, recent values, decay, turnover, reasons and status.

    ics: factor, horizon, date, ic, recent (whether the date is among the last ones of the panel);
    turnover: factor, turnover. The metrics are those of horizon 10; p is the larger of the sign test's
    tail and the normal tail, and 1 for a mean that is not positive.
    """
    at = lambda h: F.when(F.col("horizon") == h, F.col("ic"))
    own, now = at(10), F.when(F.col("recent"), at(10))
    rows = ics.groupBy("factor").agg(
        F.count(own).alias("observations"),
        F.coalesce(F.avg(own), F.lit(0.0)).alias("ic_mean"),
        F.greatest(F.coalesce(F.stddev_samp(own), F.lit(0.0)), F.lit(1e-8)).alias("sd"),
        F.coalesce(F.avg(now), F.lit(0.0)).alias("recent_mean"),
        F.greatest(F.coalesce(F.stddev_samp(now), F.lit(0.0)), F.lit(1e-8)).alias("recent_sd"),
        F.count_if(F.abs(own) > 1e-12).alias("nonzero"),
        F.count_if(own > 1e-12).alias("wins"),
        *[F.coalesce(F.avg(at(h)), F.lit(0.0)).alias(f"decay_{h}") for h in HORIZONS],
    )
    year = math.sqrt(52.0)
    rows = rows.join(turnover, "factor").withColumns({"ic_ir": F.col("ic_mean") / F.col("sd") * year, "recent_ir": F.col("recent_mean") / F.col("recent_sd") * year, "ic_t": F.col("ic_mean") / F.col("sd") * F.sqrt("observations")})
    tails = F.greatest(sign_tail(F.col("nonzero"), F.col("wins")), two_sided_normal("ic_t"))
    rows = rows.withColumn("p", F.when(F.col("ic_mean") > 0, tails).otherwise(1.0))
    rows = rows.withColumn("decay_ratio", F.abs("decay_20") / F.greatest(F.abs("decay_5"), F.abs("decay_10"), F.lit(0.01)))
    rows = rows.withColumn("why", reasons(REASONS))
    soft = (F.size("why") <= 2) & ~F.arrays_overlap("why", F.array(*[F.lit(x) for x in HARD]))
    status = F.when(F.size("why") == 0, "ACTIVE").when(soft, "WATCH").otherwise("RETIRED")
    digits = lambda c, n: F.round(c, n).alias(c)
    return rows.select("factor", "observations", digits("ic_mean", 6), digits("ic_ir", 5), digits("ic_t", 5), F.round(F.col("wins") / F.greatest("nonzero", F.lit(1)), 6).alias("positive"), digits("p", 6), digits("recent_mean", 6), digits("recent_ir", 5), *[digits(f"decay_{h}", 6) for h in HORIZONS], digits("decay_ratio", 5), digits("turnover", 6), F.array_join("why", ",").alias("reasons"), status.alias("status"))


def purged_holdout(rows: DataFrame, train: float = 0.70, selection: float = 0.85, gap_days: int = 28) -> DataFrame:
    """Add part: train, selection or approval by date, null for rows in the gaps behind the first two.

    The cuts are dates at those shares of the distinct dates; only the dates, one row each, are ordered.
    """
    dates = rows.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    cut = lambda share: F.max(F.when(F.col("k") <= F.greatest(F.floor(F.col("n") * share), F.lit(1)), F.col("date")))
    cuts = dates.agg(cut(train).alias("a"), cut(selection).alias("b"))  # one row
    d, a, b = F.col("date"), F.col("a"), F.col("b")
    part = F.when(d <= a, "train").when((d > F.date_add(a, gap_days)) & (d <= b), "selection").when(d > F.date_add(b, gap_days), "approval")
    return rows.join(F.broadcast(cuts)).withColumn("part", part).drop("a", "b")


def apply_registry(df: DataFrame, registry: list[tuple[str, float]]) -> DataFrame:
    """Add ensemble and adaptive (0 to 100): neutral factors, weighted, neutral again, as percentile of the date."""
    total = None
    for name, weight in registry:
        df = S.neutralised(df, name).withColumn("neutral", F.round("neutral", 9)).withColumnRenamed("neutral", f"__{name}")
        total = F.col(f"__{name}") * weight if total is None else total + F.col(f"__{name}") * weight
    df = df.withColumn("ensemble", F.round(total + 1e-11, 9))  # what lies on the edge of the last digit goes up
    df = df.drop(*[f"__{name}" for name, _ in registry])
    df = S.neutralised(df, "ensemble").withColumn("neutral", F.round("neutral", 9))
    return df.withColumn("adaptive", percentile_rank("neutral", "date") * 100).drop("neutral")


def live_verdict(metrics: DataFrame, least: int = 8) -> DataFrame:
    """decision by factor from metrics after the training cut-off: WARMUP, SUSPENDED, ACTIVE or WATCH."""
    decision = F.when(F.col("observations") < least, "WARMUP").when((F.col("ic_mean") <= -0.03) & (F.col("ic_ir") <= -0.25), "SUSPENDED").when((F.col("ic_mean") >= 0.01) & (F.col("ic_ir") >= 0.15), "ACTIVE").otherwise("WATCH")
    return metrics.withColumn("decision", decision)
