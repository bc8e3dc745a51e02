"""Scale-free trend, setup and risk factors at each instrument's last bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions import folds as E
from panelmill.functions import windows as W

#: Weights of the final priority.
PRIORITY = [("setup_score", 0.30), ("rps", 0.30), ("weekly_points", 0.25), ("risk_quality", 0.10), ("monthly_points", 0.05)]


def monthly_trend(months: DataFrame) -> DataFrame:
    """code, monthly_score from 13 months on: distance to the 10-month mean and its slope over three months."""
    h = E.histories(months, "close").where(F.size("h") >= 13).withColumn("e", E.ewm(E.values("close"), 2 / 11))
    now, mean, before = F.element_at("h", -1)["close"], F.element_at("e", -1), F.element_at("e", -4)
    score = 0.55 * F.tanh(F.ln(now / mean) / 0.08) + 0.45 * F.tanh(F.ln(mean / before) / 0.06)
    return h.select("code", F.round(W.clip(score, -1, 1), 6).alias("monthly_score"))


def weekly_trend(weeks: DataFrame) -> DataFrame:
    """code, weekly_score from 21 weeks on: distance in ranges, slope against the range, and efficiency over 13 weeks."""
    rows = weeks.withColumn("tr", W.true_range()).withColumn("step", F.abs(F.col("close") - W.lag("close", 1)))
    rows = rows.withColumn("path", F.sum("step").over(W.last_n(13))).withColumn("net", F.col("close") - W.lag("close", 13))
    h = E.histories(rows, "close", "tr", "path", "net").where(F.size("h") >= 21).withColumns({"e": E.ewm(E.values("close"), 2 / 21), "atr": E.ewm_last(E.values("tr"), 1 / 14)})
    last, mean, before = F.element_at("h", -1), F.element_at("e", -1), F.element_at("e", -5)
    natr = F.greatest(F.col("atr") / last["close"], F.lit(0.005))
    efficiency = F.when(last["path"] > 0, W.clip(last["net"] / last["path"], -1, 1)).otherwise(0.0)
    score = 0.40 * F.tanh((last["close"] - mean) / F.col("atr") / 2) + 0.35 * F.tanh(F.ln(mean / before) / (4 * natr)) + 0.25 * efficiency
    return h.where(F.col("atr") > 0).select("code", F.round(W.clip(score, -1, 1), 6).alias("weekly_score"))


def setup_inputs(bars: DataFrame) -> DataFrame:
    """One row an instrument with 25 bars: last bar, ranges, mean, prior extremes, volume ratio, close location."""
    rows = bars.withColumns(
        {
            "tr": W.true_range(),
            "previous": W.lag("close", 1),
            "high20": F.max("high").over(W.last_n(20, 1)),
            "swing": F.min("low").over(W.last_n(10, 1)),
            "vma": F.avg("volume").over(W.last_n(20, 1)),
        }
    )
    h = E.histories(rows, "open", "high", "low", "close", "volume", "tr", "previous", "high20", "swing", "vma").where(F.size("h") >= 25)
    ranges = {f"atr{n}": E.ewm_last(E.values("tr"), 1 / n) for n in (5, 14, 20)}
    h = h.withColumns({**ranges, "ema20": E.ewm_last(E.values("close"), 2 / 21), "x": F.element_at("h", -1)})
    spread = F.greatest(F.col("x.high") - F.col("x.low"), F.col("x.close") * 1e-6)
    return h.select(
        "code", "x.*", "atr5", "atr14", "atr20", "ema20",
        W.clip((F.col("x.close") - F.col("x.low")) / spread, 0, 1).alias("clv"),
        F.when(F.col("x.vma") > 0, F.col("x.volume") / F.col("x.vma")).otherwise(1.0).alias("vr"),
    )


def setup(inputs: DataFrame) -> DataFrame:
    """Add setup and setup_score from setup_inputs joined with weekly_score."""
    c, atr, clv, vr, weekly = (F.col(k) for k in ("close", "atr14", "clv", "vr", "weekly_score"))
    gap = (c - F.col("high20")) / atr
    dist = (c - F.col("ema20")) / atr
    out = (weekly >= 0.25) & (c >= F.col("high20")) & gap.between(0, 1) & (clv >= 0.65) & (vr >= 1.2)
    back = (weekly >= 0.25) & dist.between(-0.75, 1.25) & (c > F.col("previous")) & (c >= F.col("open")) & (clv >= 0.55) & (vr <= 1.2)
    unit = lambda v: W.clip(v, 0, 1)
    tight = unit(1 - F.col("atr5") / F.greatest(F.col("atr20"), F.lit(1e-9)))
    breakout = 100 * (0.30 * unit(1 - F.abs(gap - 0.25) / 0.75) + 0.25 * unit(F.ln(F.greatest(vr, F.lit(1.0))) / F.ln(F.lit(2.0))) + 0.25 * unit((clv - 0.5) / 0.5) + 0.20 * tight)
    pullback = 100 * (0.35 * unit(1 - F.abs(dist) / 1.5) + 0.25 * unit((clv - 0.5) / 0.5) + 0.20 * unit((1.2 - vr) / 0.7) + 0.20 * unit((c - F.col("previous")) / atr))
    df = inputs.withColumns({"b": F.when(out, breakout).otherwise(0.0), "p": F.when(back, pullback).otherwise(0.0)})
    kind = F.when((F.col("b") >= F.col("p")) & (F.col("b") > 0), "BREAKOUT").when(F.col("p") > 0, "PULLBACK").otherwise("NONE")
    return df.withColumn("setup", kind).withColumn("setup_score", F.round(F.greatest("b", "p"), 4)).drop("b", "p")


def structural_risk(df: DataFrame, price: Column | None = None, factor: Column | None = None) -> DataFrame:
    """Add stop_loss, stop_pct, atr_multiple, risk_quality, executable."""
    price = F.col("close") if price is None else price
    factor = F.lit(1.0) if factor is None else factor
    low = F.col("swing") - 0.25 * F.col("atr14")
    raw = F.when(F.col("setup") == "BREAKOUT", F.greatest(F.col("high20") - F.col("atr14"), low)).otherwise(low)
    stop = F.least(raw, F.col("close") - 1.2 * F.col("atr14")) / factor
    df = df.withColumn("stop_loss", stop).withColumn("stop_pct", (price - F.col("stop_loss")) / price * 100).withColumn("atr_multiple", (price - F.col("stop_loss")) / (F.col("atr14") / factor))
    quality = 100 * (0.55 * W.clip(1 - F.abs(F.col("atr_multiple") - 2.2) / 1.8, 0, 1) + 0.45 * W.clip(1 - F.abs(F.col("stop_pct") - 5.5) / 4.5, 0, 1))
    ok = (F.col("stop_loss") > 0) & (F.col("stop_loss") < price) & F.col("stop_pct").between(2, 10)
    return df.withColumn("executable", ok).withColumn("risk_quality", F.round(F.when(ok, quality).otherwise(0.0), 4))


def priority(df: DataFrame) -> DataFrame:
    """Add priority from setup_score, rps, weekly_score, risk_quality and monthly_score; missing parts are neutral."""
    df = df.withColumn("weekly_points", (F.coalesce("weekly_score", F.lit(0.0)) + 1) * 50).withColumn("monthly_points", (F.coalesce("monthly_score", F.lit(0.0)) + 1) * 50)
    total = None
    for name, weight in PRIORITY:
        term = F.coalesce(F.col(name), F.lit(0.0)) * weight
        total = term if total is None else total + term
    # The parts have few digits, so sums often lie on the edge of the last one; those go up, whatever the order of summing.
    return df.withColumn("priority", F.round(W.clip(total + 1e-7, 0, 100), 4))
