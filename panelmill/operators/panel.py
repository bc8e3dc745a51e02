"""The calibration panel: what was known of every instrument at each signal date, beside what happened next.

Month, week and day are scored at every bar of an instrument, in one pass over its history: the bar so far of its month and
its week is a running roll-up, and the smoothed states of the periods before come from a scan over the periods. A period's score is confirmed at the last
session of the period; a signal sees the last confirmed scores, and the unfinished ones as previews.

Signal dates are sessions of the benchmark, and an instrument's row of a signal date is its last bar so far. Bars know the sessions until the next bar,
so no range join is needed. All history work is partitioned by code, all cross-sections by signal date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import scans
from panelmill.functions import windows as W
from panelmill.operators import calendar as C
from panelmill.operators import policy, rotation, signals, trend

#: Bars before the first signal, sessions behind the last one, sessions between two.
WARM_UP, HORIZON, STEP = 252, 21, 5
LEAST_WEEKS, LEAST_MONTHS = 21, 13
#: The features of a row, in the order of the factor language.
LEAVES = ["monthly_trend", "weekly_trend", "setup_score", "relative_strength", "risk_quality", "market_score", "momentum_20", "momentum_60", "reversal_5", "trend_efficiency_20", "volatility_20", "downside_volatility_60", "volume_confirmation", "liquidity_log"]


def periods(bars: DataFrame, unit: str, means: dict[str, tuple[str, float]]) -> DataFrame:
    """One row a period: code, period, p (its number), and what a bar of the period needs of those before it.

    close1, path12 (steps of the 12 periods before), close13, and for each mean the states one and lag periods before (name1, name3, name4).
    """
    rows = C.roll_up(bars, unit).select("code", F.col("period").alias("date"), "high", "low", "close")
    rows = rows.withColumns({"tr": W.true_range(), "step": F.abs(F.col("close") - W.lag("close", 1)), "p": F.row_number().over(W.by_code())})
    rows = scans.smoothed(rows, means, "close", "tr", "step", "p")
    lags = {f"{k}{n}": W.lag(k, n) for k in means for n in (1, 3, 4)}
    rows = rows.withColumns({**lags, "close1": W.lag("close", 1), "close13": W.lag("close", 13), "path12": F.sum("step").over(W.last_n(12, 1))})
    return rows.select("code", F.col("date").alias("period"), "p", *lags, "close1", "close13", "path12")


def month_scores(bars: DataFrame) -> DataFrame:
    """code, date, close, month_score (0 before the 13th month) of the month so far at every bar."""
    before = periods(bars, "month", {"e": ("close", 2 / 11)})
    rows = bars.select("code", "date", "close", C.period_of("month").alias("period")).join(before, ["code", "period"])
    mean = F.col("e1") * (1 - 2 / 11) + F.col("close") * (2 / 11)
    score = 0.55 * F.tanh(F.ln(F.col("close") / mean) / 0.08) + 0.45 * F.tanh(F.ln(mean / F.col("e3")) / 0.06)
    sound = (F.col("p") >= LEAST_MONTHS) & (F.least("close", mean, "e3") > 0)
    return rows.select("code", "date", "period", F.when(sound, F.round(W.clip(score, -1, 1), 6)).otherwise(0.0).alias("month_score"))


def week_scores(bars: DataFrame) -> DataFrame:
    """code, date, period, week_score (0 before the 21st week) of the week so far at every bar."""
    before = periods(bars, "week", {"e": ("close", 2 / 21), "a": ("tr", 1 / 14)})
    rows = bars.select("code", "date", "high", "low", "close", C.period_of("week").alias("period"))
    so_far = Window.partitionBy("code", "period").orderBy("date")
    rows = rows.withColumns({"top": F.max("high").over(so_far), "bottom": F.min("low").over(so_far)}).join(before, ["code", "period"])
    tr = F.greatest(F.col("top") - F.col("bottom"), F.abs(F.col("top") - F.col("close1")), F.abs(F.col("bottom") - F.col("close1")))
    rows = rows.withColumns({"mean": F.col("e1") * (1 - 2 / 21) + F.col("close") * (2 / 21), "atr": F.col("a1") * (1 - 1 / 14) + tr * (1 / 14), "path": F.col("path12") + F.abs(F.col("close") - F.col("close1"))})
    natr = F.greatest(F.col("atr") / F.col("close"), F.lit(0.005))
    efficiency = F.when(F.col("path") > 0, W.clip((F.col("close") - F.col("close13")) / F.col("path"), -1, 1)).otherwise(0.0)
    score = 0.40 * F.tanh((F.col("close") - F.col("mean")) / F.col("atr") / 2) + 0.35 * F.tanh(F.ln(F.col("mean") / F.col("e4")) / (4 * natr)) + 0.25 * efficiency
    sound = (F.col("p") >= LEAST_WEEKS) & (F.least("close", "atr", "mean", "e4") > 0)
    return rows.select("code", "date", "period", F.when(sound, F.round(W.clip(score, -1, 1), 6)).otherwise(0.0).alias("week_score"))


def confirmed_on(scores: DataFrame, value: str, sessions: DataFrame, unit: str) -> DataFrame:
    """code, date, value: the last score of each period, dated by the last session of that period."""
    ends = sessions.groupBy(C.period_of(unit).alias("period")).agg(F.max("date").alias("end"))
    last = scores.groupBy("code", "period").agg(F.max_by(value, "date").alias(value))
    return last.join(ends, "period").select("code", F.col("end").alias("date"), value)


def signal_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions (date, session from 1) with signal set for every fifth between warm-up and horizon. One row a day."""
    rows = sessions.withColumns({"session": F.row_number().over(Window.orderBy("date")), "last": F.count(F.lit(1)).over(Window.partitionBy())})
    behind = F.col("session") - 1 - WARM_UP
    return rows.select("date", "session", ((behind >= 0) & (F.col("session") - 1 < F.col("last") - HORIZON) & (behind % STEP == 0)).alias("signal"))


def at_signals(bars: DataFrame, numbered: DataFrame) -> DataFrame:
    """The last bar so far at each signal session: bars (with n and m, its number and the number of all) and signal_date."""
    rows = bars.join(numbered.select("date", "session"), "date").withColumn("until", F.coalesce(F.lead("session").over(W.by_code()) - 1, F.col("session")))
    rows = rows.where((F.col("n") >= WARM_UP) & (F.col("m") - F.col("n") >= HORIZON))
    # The signal sessions that the bar stays the last one for: from the first at or behind it on.
    first = F.col("session") + F.pmod(F.lit(WARM_UP + 1) - F.col("session"), F.lit(STEP))
    rows = rows.where(first <= F.col("until")).withColumn("session", F.explode(F.sequence(first, "until", F.lit(STEP))))
    return rows.join(numbered.where("signal").select("session", F.col("date").alias("signal_date")), "session").drop("session", "until")


def day_inputs(rows: DataFrame) -> DataFrame:
    """What setup and risk read, at every bar; rows have the bars and any columns to keep."""
    spread = F.greatest(F.col("high") - F.col("low"), F.col("close") * 1e-6)
    rows = rows.withColumns({"tr": W.true_range(), "previous": W.lag("close", 1), "high20": F.max("high").over(W.last_n(20, 1)), "swing": F.min("low").over(W.last_n(10, 1)), "vma": F.avg("volume").over(W.last_n(20, 1))})
    kept = [c for c in rows.columns if c not in ("code", "date")]
    rows = scans.smoothed(rows, {"atr5": ("tr", 1 / 5), "atr14": ("tr", 1 / 14), "atr20": ("tr", 1 / 20), "ema20": ("close", 2 / 21)}, *kept)
    return rows.withColumns({"clv": W.clip((F.col("close") - F.col("low")) / spread, 0, 1), "vr": F.when(F.col("vma") > 0, F.col("volume") / F.col("vma")).otherwise(1.0)})


def market(scored: DataFrame, bench: DataFrame) -> DataFrame:
    """One row a signal date: the policy from all instruments' confirmed week scores and the benchmark's trend, stress and thrust.

    scored: signal_date, weekly_score; bench: date, close, a price a session (one series).
    """
    series = bench.select(F.lit("*").alias("code"), "date", F.col("close").alias("high"), F.col("close").alias("low"), "close", F.col("close").alias("open"), F.lit(0.0).alias("volume"))
    weekly = confirmed_on(week_scores(series), "week_score", bench.select("date"), "week")
    daily = scans.smoothed(series.withColumn("tr", W.true_range()), {"atr": ("tr", 1 / 14)}, "close", "tr")
    daily = daily.withColumns({"natr": F.round(F.col("atr") / F.col("close"), 9), "n": F.row_number().over(W.by_code()), **{f"ret_{k}": F.coalesce(F.round(F.col("close") / W.lag("close", k) - 1, 9), F.lit(0.0)) for k in (1, 3, 5, 10)}})
    # A mean counts from its 14th bar on.
    past = F.collect_list(F.when(F.col("n") >= 14, F.col("natr"))).over(W.last_n(120))
    daily = daily.withColumn("past", past)
    daily = daily.withColumn("stress", F.when((F.col("n") < 30) | (F.size("past") < 20), 50.0).otherwise(F.size(F.filter("past", lambda x: x < F.col("natr"))) / F.size("past") * 100)).drop("past")
    daily = C.as_of(daily.select("code", "date"), weekly, "week_score").join(daily, ["code", "date"])
    breadth = scored.groupBy("signal_date").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("weekly_score") >= 0.25).alias("bull"), F.count_if(F.col("weekly_score") <= -0.25).alias("bear"))
    rows = breadth.join(daily.withColumnRenamed("date", "signal_date"), "signal_date").withColumns({"trend": F.coalesce("week_score", F.lit(0.0)), "stress": F.round("stress", 6)})
    return policy.market_policy(rows).select("signal_date", F.round("score", 6).alias("market_score"), F.col("state").alias("market_state"), "permission", F.col("exposure").alias("max_exposure"))


def calibration_panel(bars: DataFrame, bench: DataFrame, primitives: DataFrame, labels: DataFrame, crossed: DataFrame | None = None) -> DataFrame:
    """One row an instrument and signal date, with 14 features, market, setup, risk, priority, baseline flag and labels.

    bars: code, date, open, high, low, close, volume; bench: date, close; primitives: code, date and the eight price features; labels: code, date
    (of the last bar), early_stop, win_10d, excess columns; crossed: code, date of bars whose label crosses a price adjustment, which give no row.
    """
    sessions, whole = signal_sessions(bench.select("date")), Window.partitionBy("code")
    weeks, months = week_scores(bars), month_scores(bars)
    # The keys of the panel and the scores known at them come first, from few columns; what is wide is joined once.
    numbered = bars.select("code", "date").withColumns({"n": F.row_number().over(W.by_code()), "m": F.count(F.lit(1)).over(whole)})
    known = at_signals(numbered, sessions).select("code", "date", "signal_date")
    for scores, value, unit, name in ((weeks, "week_score", "week", "weekly_score"), (months, "month_score", "month", "monthly_score")):
        found = C.as_of(known.select("code", F.col("signal_date").alias("date")), confirmed_on(scores, value, bench.select("date"), unit), value)
        known = known.join(found.select("code", F.col("date").alias("signal_date"), F.coalesce(value, F.lit(0.0)).alias(name)), ["code", "signal_date"])
    known = known.persist()
    policies = market(known.select("signal_date", "weekly_score"), bench)
    strength = rotation.strength_inputs(bars.select("code", "date", "close"), bench.select("date", F.col("close").alias("bench"))).drop("m", "t")
    previews = weeks.select("code", "date", F.col("week_score").alias("weekly_preview")).join(months.select("code", "date", F.col("month_score").alias("monthly_preview")), ["code", "date"])
    rows = known.join(day_inputs(bars), ["code", "date"]).join(previews, ["code", "date"]).join(strength, ["code", "date"], "left").join(primitives, ["code", "date"]).withColumn("bar_date", F.col("date"))
    rows = rotation.strength_score(rows, "signal_date").withColumn("rps", F.round("strength", 2))
    rows = trend.priority(trend.structural_risk(trend.setup(rows)))
    rows = rows.join(policies, "signal_date")
    if crossed is not None:
        rows = rows.join(crossed.select("code", F.col("date").alias("bar_date")).distinct(), ["code", "bar_date"], "left_anti")
    rows = rows.join(labels.withColumnRenamed("date", "bar_date"), ["code", "bar_date"])
    base = rows.withColumn("baseline", F.expr(signals.BASELINE))
    features: dict[str, Column] = {
        "monthly_trend": F.col("monthly_score"),
        "weekly_trend": F.col("weekly_score"),
        "setup_raw": F.col("setup_score"),
        "setup_score": F.col("setup_score") / 100,
        "relative_strength": F.col("rps") / 100,
        "risk_quality": F.col("risk_quality") / 100,
    }
    return base.withColumns(features)
