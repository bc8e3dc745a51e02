"""Rule scores of the market environment, and exposure caps of an equity path.

Thresholds are data: ordered conditions that both Spark and the comparison SQL read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values. Ordered (condition, points); the first that holds counts. Inputs: close, ma20, ma60, ma120.
TREND = [
    ("ma20 IS NULL", 0.0),
    ("ma120 IS NULL AND close > ma20", 1.0),
    ("ma120 IS NULL AND close < ma20", -1.0),
    ("ma120 IS NULL", 0.0),
    ("close > ma20 AND ma20 > ma60 AND ma60 > ma120", 4.0),
    ("close > ma60 AND ma60 > ma120 AND close > ma20", 3.5),
    ("close > ma60 AND ma60 > ma120", 2.5),
    ("close > ma20 AND close > ma60", 2.0),
    ("close > ma20 AND abs(close - ma20) / ma20 * 100 < 1.5", 0.0),
    ("close > ma20", 1.0),
    ("close < ma20 AND ma20 < ma60 AND ma60 < ma120", -4.0),
    ("close < ma60 AND ma60 < ma120 AND close < ma20", -3.5),
    ("close < ma60 AND ma60 < ma120", -2.5),
    ("close < ma20 AND close < ma60", -2.0),
    ("close < ma20 AND abs(close - ma20) / ma20 * 100 < 1.5", 0.0),
    ("close < ma20", -1.0),
]
#: h0 is the last histogram, h1 to h3 those before it.
RISES, FALLS = "(h2 > 0 AND h1 > 0 AND h0 > 0 AND h2 >= h3 AND h1 >= h2 AND h0 >= h1)", "(h2 < 0 AND h1 < 0 AND h0 < 0 AND h2 <= h3 AND h1 <= h2 AND h0 <= h1)"
MOMENTUM = [
    (f"h0 > 0 AND h1 <= 0 AND {RISES}", 3.0),
    ("h0 > 0 AND h1 <= 0", 2.5),
    (f"h0 > 0 AND {RISES}", 2.0),
    ("h0 > 0 AND h0 < h1", 1.0),
    ("h0 > 0", 1.5),
    (f"h0 < 0 AND h1 >= 0 AND {FALLS}", -3.0),
    ("h0 < 0 AND h1 >= 0", -2.5),
    (f"h0 < 0 AND {FALLS}", -2.0),
    ("h0 < 0 AND h0 > h1", -1.0),
    ("h0 < 0", -1.5),
]
VOLUME = [
    ("vr > 1.5 AND close > previous", 2.0),
    ("vr > 1.0 AND close > previous", 1.0),
    ("vr < 0.7 AND close > previous", 0.5),
    ("vr > 1.5 AND close < previous", -2.0),
    ("vr > 1.0 AND close < previous", -1.0),
    ("vr < 0.7 AND close < previous", -0.5),
]
VOLATILITY = [
    ("atr_pct > 2.0 AND pctl < 25", -1.5),
    ("atr_pct > 2.0", -2.0),
    ("atr_pct > 1.2 AND pctl < 25", -0.5),
    ("atr_pct > 1.2", -1.0),
    ("atr_pct >= 0.8 AND pctl > 75", -0.5),
    ("atr_pct >= 0.8", 0.0),
    ("atr_pct >= 0.5 AND pctl > 75", 0.5),
    ("atr_pct >= 0.5", 1.0),
    ("pctl > 75", 1.5),
]
WEIGHTS = {"trend": 1.0, "momentum": 0.8, "volume": 0.6, "volatility": 0.4}
STATUS = [("total >= 4.5", "STRONG_BULL"), ("total >= 1.5", "BULL"), ("total >= -1.5", "NEUTRAL"), ("total >= -4.5", "BEAR")]
LEAST_BARS, DEFENCE = 120, -6.0

#: Fixed values of the exposure caps: inputs abs_dd, rel_dd, life_dd.
ABSOLUTE = [("abs_dd >= 0.20", 0.38), ("abs_dd >= 0.16", 0.52), ("abs_dd >= 0.12", 0.68), ("abs_dd >= 0.08", 0.82)]
RELATIVE = [("rel_dd >= 0.26", 0.70), ("rel_dd >= 0.22", 0.80)]
CLIFF = [("life_dd >= 0.245", 0.45), ("life_dd >= 0.235", 0.58), ("life_dd >= 0.22", 0.72)]
HEALING = "(NOT new_low AND bench_up >= 0.02 AND ((dd < dd1 - 1e-12 AND dd1 < dd2 - 1e-12) OR from_trough >= 0.015))"
APPLIES = """CASE WHEN life_dd >= 0.18 THEN true WHEN life_dd >= 0.12 THEN NOT (state LIKE 'PULSE_FULL%' OR score >= 0.35)
  ELSE NOT (state LIKE 'PULSE_FULL%' OR state LIKE 'PULSE_EARLY%' OR score >= 0.20 OR state IN ('NORMAL', 'CAUTIOUS')) END"""
TRAIL, LOOKBACK = 52, 12


def case(rules: list[tuple], otherwise) -> str:
    """The ordered rules as a CASE expression of either engine."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return "CASE " + " ".join(f"WHEN {c} THEN {show(v)}" for c, v in rules) + f" ELSE {show(otherwise)} END"


TOTAL = " + ".join(f"{w} * {k}" for k, w in WEIGHTS.items())
PARTS = {"trend": case(TREND, 0.0), "momentum": case(MOMENTUM, 0.0), "volume": case(VOLUME, 0.0), "volatility": case(VOLATILITY, 2.0)}
FINAL = {"total": f"CASE WHEN bars >= {LEAST_BARS} THEN round(CAST({TOTAL} AS DOUBLE), 1) ELSE CAST({DEFENCE} AS DOUBLE) END"}
REPORT = {
    "status": case(STATUS, "STRONG_BEAR"),
    "risk_level": "CASE WHEN total >= 3 THEN 'LOW' WHEN total >= -1.5 THEN 'MIDDLE' ELSE 'HIGH' END",
    "atr_multiplier": "round(CAST(1.2 + (greatest(-6, least(6, total)) + 6) / 12 * 1.3 + 1e-9 AS DOUBLE), 1)",
}


def environment(inputs: DataFrame) -> DataFrame:
    """Add the four scores, total, status, risk_level and atr_multiplier. inputs: bars, close, previous, ma20,
    ma60, ma120, h0 to h3, vr, atr_pct, pctl. Below 120 bars the total is the defensive -6."""
    for step in (PARTS, FINAL, REPORT):
        inputs = inputs.withColumns({k: F.expr(e) for k, e in step.items()})
    return inputs


def exposure_caps(paths: DataFrame) -> DataFrame:
    """Add life_dd, healing and cap to equity paths (code, date, s, b): a cap of the next exposure from the path so far.

    A mild cap follows the drawdown of the last 52 rows, a hard one that of the whole life; a path that heals while the
    benchmark rises gets 0.12 back. Two windows of one partitioning: one shuffle. Paths of one row have no cap.
    """
    w = Window.partitionBy("code").orderBy("date")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    rel = (F.col("s") / F.first("s").over(w)) / (F.col("b") / F.first("b").over(w))
    rows = paths.withColumns({"k": F.row_number().over(w), "peak": F.max("s").over(w), "trail": F.max("s").over(last(TRAIL)), "rel": rel, "b_peak": F.max("b").over(w), "low": F.min("s").over(last(LOOKBACK)), "b_low": F.min("b").over(last(LOOKBACK))})
    rows = rows.withColumns({"dd": F.round(1 - F.col("s") / F.col("peak"), 9), "trail_dd": F.round(1 - F.col("s") / F.col("trail"), 9), "rel_dd": F.round(1 - F.col("rel") / F.max("rel").over(w), 9), "from_trough": F.round((F.col("s") - F.col("low")) / F.col("peak"), 9), "bench_up": F.round((F.col("b") - F.col("b_low")) / F.col("b_peak"), 9)})
    rows = rows.withColumns({"life_dd": F.col("dd"), "dd1": F.lag("dd", 1).over(w), "dd2": F.lag("dd", 2).over(w), "new_low": F.col("dd") >= F.max("dd").over(last(LOOKBACK)) - 1e-12})
    for step in CAP_STEPS:
        rows = rows.withColumns({k: F.expr(e) for k, e in step.items()})
    return rows


CAP_STEPS = [
    {"abs_dd": "greatest(trail_dd, " + case([("life_dd >= 0.24", 0.16), ("life_dd >= 0.22", 0.12)], 0.0) + ")", "healing": f"coalesce({HEALING}, false)"},
    {"cap0": f"least({case(ABSOLUTE, 1.0)}, {case(RELATIVE, 1.0)})"},
    {"cap1": "CASE WHEN healing THEN greatest(cap0, least(CAST(0.95 AS DOUBLE), cap0 + CAST(0.12 AS DOUBLE))) ELSE cap0 END"},
    {"cap": f"CASE WHEN k < 2 THEN CAST(1 AS DOUBLE) ELSE round(least(cap1, {case(CLIFF, 1.0)}), 6) END"},
]


def capacity_targets(scored: DataFrame, value: float, n: int, participation: float) -> DataFrame:
    """The best of each group whose daily amount carries an equal share of the portfolio, at most n a date.

    Fewer names mean larger shares, which fewer names can carry: the number of names is stepped down from n until it
    holds. The selections for 1 to n names come from one pass (each row for each number of names it can carry), and the
    steps are looked up in their sizes. scored: date, code, industry_group, rotation_score, adv.
    """
    sizes = F.array(*[F.lit(d) for d in range(1, n + 1)])
    rows = scored.withColumn("names", F.explode(F.filter(sizes, lambda d: F.col("adv") >= F.lit(value) / d / participation)))
    order = [F.desc("rotation_score"), "code"]
    rows = rows.withColumn("g", F.row_number().over(Window.partitionBy("date", "names", "industry_group").orderBy(*order))).where("g = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("date", "names").orderBy(*order))).where(F.col("rank") <= F.lit(n))
    found = rows.groupBy("date", "names").agg(F.count(F.lit(1)).cast("int").alias("c"))
    found = found.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("names", "c"))).alias("m"))
    step = F.lit(n)
    for _ in range(n):
        step = F.greatest(F.lit(1), F.coalesce(F.try_element_at("m", step), F.lit(0)))
    return rows.join(found.select("date", step.alias("names")), ["date", "names"]).select("date", "code", "rank", "names")
