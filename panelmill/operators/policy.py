"""Market policy: breadth and trend to a score, thrust to a pulse, both to permission and exposure.

The thresholds are data. Both the Spark columns and the comparison SQL are built from these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. Conditions on ret_1, ret_3, ret_5, ret_10 (thrust), stress and raw_score; the first rule that holds counts.
STRONG = "(ret_5 >= 0.06 OR ret_3 >= 0.04 OR (ret_1 >= 0.03 AND ret_3 >= 0.025))"
MILD = "(ret_5 >= 0.035 OR ret_3 >= 0.025 OR (ret_1 >= 0.02 AND ret_5 >= 0.02))"
EARLY = "(ret_3 >= 0.012 OR ret_5 >= 0.015 OR (ret_1 >= 0.008 AND ret_3 >= 0.008))"
PULSES = [
    (f"{STRONG} AND (stress >= 90 OR (raw_score < 0.1 AND raw_score >= -0.45))", "FULL"),
    (f"{MILD} AND stress >= 90 AND raw_score >= -0.45", "MILD"),
    (f"{EARLY} AND NOT {MILD} AND raw_score < 0 AND raw_score >= -0.55 AND ret_10 > -0.05 AND NOT (raw_score < -0.45 AND ret_3 < 0.012) AND NOT (raw_score >= -0.45 AND stress < 55 AND ret_1 < 0.008)", "EARLY"),
]
EXPOSURE_FLOORS = [("pulse = 'FULL' AND raw_score >= 0", 1.0), ("pulse = 'FULL'", 0.85), ("pulse = 'MILD'", 0.7), ("pulse = 'EARLY' AND raw_score >= -0.3", 0.85), ("pulse = 'EARLY'", 0.7)]
SCORE_FLOORS = [("pulse = 'FULL' OR pulse = 'EARLY'", 0.0), ("pulse = 'MILD'", -0.1)]
#: condition, permission, exposure, state
LADDER = [
    ("pulse = 'FULL' AND score < -0.5", "MAINLINE_ONLY", 0.7, "PULSE_HARD"),
    ("pulse = 'FULL' AND score < 0.05", "MAINLINE_ONLY", 0.9, "PULSE_CAUTIOUS"),
    ("pulse = 'FULL'", "TRADEABLE", 1.0, "PULSE_FULL"),
    ("pulse <> 'NONE' AND score < -0.5", "MAINLINE_ONLY", 0.5, "PULSE_HARD"),
    ("pulse = 'EARLY' AND score < 0", "MAINLINE_ONLY", 0.85, "PULSE_EARLY"),
    ("pulse = 'MILD' AND score < 0", "MAINLINE_ONLY", 0.7, "PULSE_CAUTIOUS"),
    ("pulse = 'EARLY' AND score < 0.2", "MAINLINE_ONLY", 0.9, "PULSE_EARLY"),
    ("pulse = 'MILD' AND score < 0.2", "MAINLINE_ONLY", 0.9, "PULSE_CAUTIOUS"),
    ("pulse <> 'NONE'", "TRADEABLE", 1.0, "PULSE_FULL"),
    ("score < -0.5 OR (stress >= 98 AND score < 0)", "BLOCKED", 0.0, "RISK_OFF"),
    ("stress >= 98 AND score >= 0.35", "MAINLINE_ONLY", 0.7, "DEFENSIVE"),
    ("stress >= 98", "MAINLINE_ONLY", 0.5, "HARD_DEFENSIVE"),
    ("stress >= 96 AND score >= 0.25", "MAINLINE_ONLY", 0.9, "CAUTIOUS"),
    ("stress >= 96 AND score >= 0", "MAINLINE_ONLY", 0.7, "DEFENSIVE"),
    ("stress >= 96", "MAINLINE_ONLY", 0.5, "HARD_DEFENSIVE"),
    ("score < -0.25", "MAINLINE_ONLY", 0.5, "HARD_DEFENSIVE"),
    ("score < 0", "MAINLINE_ONLY", 0.7, "DEFENSIVE"),
    ("score < 0.2", "MAINLINE_ONLY", 0.9, "CAUTIOUS"),
]
TOP = ("TRADEABLE", 1.0, "NORMAL")
TREND, BREADTH, VOLATILITY = 0.55, 0.35, 0.10


def _first(rules: list[tuple], value: int, otherwise) -> Column:
    out = F.lit(otherwise)
    for rule in reversed(rules):
        out = F.when(F.expr(rule[0]), F.lit(rule[value])).otherwise(out)
    return out


def exposure_ladder(df: DataFrame) -> DataFrame:
    """Add permission, exposure, state from score, stress and pulse."""
    return df.withColumns({"permission": _first(LADDER, 1, TOP[0]), "exposure": _first(LADDER, 2, TOP[1]), "state": _first(LADDER, 3, TOP[2])})


def policy_pulse(df: DataFrame) -> DataFrame:
    """Add pulse and its floors from ret_1, ret_3, ret_5, ret_10, stress and raw_score."""
    df = df.withColumn("pulse", _first(PULSES, 1, "NONE"))
    return df.withColumns({"exposure_floor": _first(EXPOSURE_FLOORS, 1, 0.0), "score_floor": _first(SCORE_FLOORS, 1, -1.0)})


def market_policy(df: DataFrame) -> DataFrame:
    """From bull, bear, total, trend, stress and the thrusts to score, state, permission and exposure."""
    # Shares of few rows often lie on the edge of the last digit; those go up, whatever the order of summing.
    raw = TREND * F.col("trend") + BREADTH * F.coalesce(F.try_divide(F.col("bull") - F.col("bear"), F.col("total")), F.lit(0.0)) - VOLATILITY * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("stress") - 50) / 50))
    df = policy_pulse(df.withColumn("raw_score", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)) + 1e-9, 6)))
    df = df.withColumn("score", F.when(F.col("pulse") != "NONE", F.greatest("raw_score", "score_floor")).otherwise(F.col("raw_score")))
    df = exposure_ladder(df)
    df = df.withColumn("exposure", F.when(F.col("pulse") != "NONE", F.greatest("exposure", "exposure_floor")).otherwise(F.col("exposure")))
    lifted = F.when(F.col("exposure") >= 0.999, "TRADEABLE").when((F.col("permission") == "BLOCKED") & (F.col("exposure") > 0), "MAINLINE_ONLY").otherwise(F.col("permission"))
    return df.withColumn("permission", F.when(F.col("pulse") != "NONE", lifted).otherwise(F.col("permission")))


def _case(rules: list[tuple], value: int, otherwise) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {show(r[value])}" for r in rules) + f" ELSE {show(otherwise)} END"


def policy_sql(source: str) -> str:
    """The same composition as SQL expressions, ending in a table named policy."""
    return f"""p1 AS (SELECT *, round(greatest(-1, least(1, {TREND} * trend + {BREADTH} * ((bull - bear) / total) - {VOLATILITY} * greatest(0, least(1, (stress - 50) / 50)))) + 1e-9, 6) AS raw_score FROM {source}),
p2 AS (SELECT *, {_case(PULSES, 1, 'NONE')} AS pulse FROM p1),
p3 AS (SELECT *, {_case(EXPOSURE_FLOORS, 1, 0.0)} AS ef, {_case(SCORE_FLOORS, 1, -1.0)} AS sf FROM p2),
p4 AS (SELECT *, CASE WHEN pulse <> 'NONE' THEN greatest(raw_score, sf) ELSE raw_score END AS score FROM p3),
p5 AS (SELECT *, {_case(LADDER, 1, TOP[0])} AS pm, {_case(LADDER, 2, TOP[1])} AS ex, {_case(LADDER, 3, TOP[2])} AS state FROM p4),
p6 AS (SELECT *, CASE WHEN pulse <> 'NONE' THEN greatest(ex, ef) ELSE ex END AS exposure FROM p5),
policy AS (SELECT *, CASE WHEN pulse = 'NONE' THEN pm WHEN exposure >= 0.999 THEN 'TRADEABLE' WHEN pm = 'BLOCKED' AND exposure > 0 THEN 'MAINLINE_ONLY' ELSE pm END AS permission FROM p6)
"""
