"""Portfolio simulation and path statistics.

A simulation depends on its own past, so one parameter set is one sequential task; parameter sets
run side by side as groups. A group holds the picks of all dates (a few names each), not the panel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import costs

EQUITY = "buffer int, date date, strategy double, holdings int, turnover double, cost double"


def simulate(picks: DataFrame) -> DataFrame:
    """Equal-weight rotation by parameter set. picks: buffer, date, code, price, next_price, adv.

    Each date the names that are no longer picked are sold before others are bought; trades pay the
    square-root impact cost. Returns the equity by date.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        equity, held, out = 10_000.0, {}, []
        for day, rows in pdf.sort_values(["date", "code"]).groupby("date", sort=True):
            target = {r.code: 1.0 / len(rows) for r in rows.itertuples()}
            adv = {r.code: r.adv for r in rows.itertuples()}
            moved = {c: abs(target.get(c, 0.0) - held.get(c, 0.0)) for c in sorted({*target, *held})}
            cost = 0.0
            for code, share in moved.items():
                gross = equity * share
                part = min(gross / max(adv.get(code, 0.0), gross), costs.MOST_PARTICIPATION) if gross > 0 else 0.0
                cost += gross * (costs.COMMISSION + costs.HANDLING + (costs.HALF_SPREAD_BPS + costs.SLIPPAGE_BPS + costs.IMPACT_BPS * part**0.5) / 1e4)
            growth = {r.code: r.next_price / r.price for r in rows.itertuples()}
            grown = sum(target[c] * growth[c] for c in target)
            equity = (equity - cost) * grown
            held = {c: target[c] * growth[c] / grown for c in target}
            out.append((int(key[0]), day, round(equity, 6), len(rows), round(sum(moved.values()) / 2, 8), round(cost, 8)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EQUITY.split(", ")])

    return picks.groupBy("buffer").applyInPandas(run, EQUITY)


def yearly_returns(returns: DataFrame) -> DataFrame:
    """code, year, compounded return of rows (code, date, r)."""
    return returns.groupBy("code", F.year("date").alias("year")).agg((F.product(1 + F.col("r")) - 1).alias("compounded"))


def rolling_stability(returns: DataFrame, n: int = 52) -> DataFrame:
    """Per code: share of windows of n with positive excess, worst and middle excess, and worst drawdown. rows: code, date, r, rb."""
    w = Window.partitionBy("code").orderBy("date")
    last = w.rowsBetween(-(n - 1), 0)
    rows = returns.withColumns({"k": F.row_number().over(w), "s": F.product(1 + F.col("r")).over(last) - 1, "b": F.product(1 + F.col("rb")).over(last) - 1, "nav": F.exp(F.sum(F.ln(1 + F.col("r"))).over(w))})
    rows = rows.withColumn("dd", 1 - F.col("nav") / F.max("nav").over(w)).withColumn("e", F.when(F.col("k") >= n, F.round(F.col("s") - F.col("b"), 9)))
    return rows.groupBy("code").agg(
        F.count("e").alias("windows"),
        F.round(F.avg((F.col("e") > 0).cast("double")), 6).alias("positive"),
        F.round(F.min("e"), 6).alias("worst"),
        F.round(F.percentile("e", 0.5), 6).alias("middle"),
        F.round(F.max("dd"), 6).alias("worst_drawdown"),
    )


#: Gates of acceptance and the conditions under which each fails.
GATES = [
    ("RETURN_NOT_POSITIVE", "total_return <= 0"),
    ("EXCESS_NOT_POSITIVE", "excess_return <= 0"),
    ("INFORMATION_RATIO_BELOW_0_3", "information_ratio < 0.3"),
    ("SHARPE_BELOW_0_5", "sharpe < 0.5"),
    ("DRAWDOWN_ABOVE_BENCHMARK", "max_drawdown > benchmark_drawdown"),
    ("FEWER_THAN_HALF_OF_YEARS_POSITIVE", "positive_years < 0.5"),
    ("FEWER_THAN_52_PERIODS", "periods < 52"),
]


def summary(returns: DataFrame) -> DataFrame:
    """One row a code from its weekly path (code, date, r, rb): returns, ratios, drawdowns, share of years ahead of the benchmark."""
    w = Window.partitionBy("code").orderBy("date")
    rows = returns.withColumns({"nav": F.exp(F.sum(F.ln(1 + F.col("r"))).over(w)), "bnav": F.exp(F.sum(F.ln(1 + F.col("rb"))).over(w))})
    fall = lambda nav: 1 - F.col(nav) / F.greatest(F.lit(1.0), F.max(nav).over(w))
    rows = rows.withColumns({"dd": fall("nav"), "bdd": fall("bnav"), "active": F.col("r") - F.col("rb")})
    ratio = lambda c: F.avg(c) / F.greatest(F.stddev_samp(c), F.lit(1e-8)) * F.sqrt(F.lit(52.0))
    whole = rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("periods"),
        (F.max_by("nav", "date") - 1).alias("total"),
        (F.max_by("bnav", "date") - 1).alias("btotal"),
        F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1 / 52)).alias("years"),
        ratio("active").alias("ir"),
        ratio("r").alias("sharpe"),
        F.max("dd").alias("dd"),
        F.max("bdd").alias("bdd"),
    )
    years = rows.groupBy("code", F.year("date").alias("y")).agg(F.round(F.product(1 + F.col("r")) - F.product(1 + F.col("rb")), 9).alias("e")).groupBy("code").agg(F.avg((F.col("e") > 0).cast("double")).alias("py"))
    six = lambda c, name: F.round(c, 6).alias(name)
    return whole.join(years, "code").select("code", "periods", six(F.col("total"), "total_return"), six(F.pow(1 + F.col("total"), 1 / F.col("years")) - 1, "cagr"), six(F.col("btotal"), "benchmark_return"), six(F.col("total") - F.col("btotal"), "excess_return"), F.round("ir", 5).alias("information_ratio"), F.round("sharpe", 5).alias("sharpe"), six(F.col("dd"), "max_drawdown"), six(F.col("bdd"), "benchmark_drawdown"), six(F.col("py"), "positive_years"))
