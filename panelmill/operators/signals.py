"""State of an entry signal, baseline candidates, calibration inputs and approval of a set of factors.

Rules are data: ordered (name, condition) that both Spark and the comparison SQL read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a calibration that lacks a number counts as.
DEFAULTS = {"early_stop": 1.0, "win": 0.0, "excess": 0.0, "early_stop_max": 0.2143, "priority_min": 65.0, "setup_min": 60.0}
#: The numbers of a signal and the range they are cut to.
RANGES = {"priority": (0, 100), "setup_score": (0, 100), "monthly_score": (-1, 1), "weekly_score": (-1, 1), "early_stop": (0, 1), "win": (0, 1), "early_stop_max": (0.05, 0.60), "priority_min": (0, 100), "setup_min": (0, 100)}
MAINLINE = "history_ok AND has_120 AND monthly_score >= 0.20 AND weekly_score >= 0.60 AND relative_strength >= 80.0 AND priority >= 75.0"
FLOOR = "CASE WHEN history_ok THEN 0.25 ELSE 0.50 END"
#: Reasons against an entry, in their order. target: an approved rotation target, which skips all but the hard ones.
REASONS = [
    ("DATA_QUALITY_NOT_VALID", "quality <> 'VALID'"),
    ("CALIBRATION_NOT_APPROVED", "NOT approved AND NOT target"),
    ("RISK_NOT_EXECUTABLE", "NOT executable"),
    ("MARKET_BLOCKED", "permission = 'BLOCKED'"),
    ("MARKET_MAINLINE_ONLY", "NOT target AND permission = 'MAINLINE_ONLY' AND NOT mainline"),
    ("WEEKLY_TREND_NOT_CONFIRMED", f"NOT target AND weekly_score < {FLOOR}"),
    ("MONTHLY_TREND_NEGATIVE", "NOT target AND history_ok AND monthly_score < -0.15"),
    ("SETUP_NOT_CONFIRMED", "NOT target AND (setup = 'NONE' OR setup_score < setup_min)"),
    ("EARLY_STOP_RISK_HIGH", "NOT target AND early_stop > early_stop_max"),
    ("EXPECTED_EXCESS_NOT_POSITIVE", "NOT target AND excess <= 0"),
    ("PRIORITY_BELOW_THRESHOLD", "NOT target AND priority < priority_min"),
]
BLOCKED = "(NOT approved AND NOT target) OR quality = 'BLOCKED' OR NOT executable OR permission = 'BLOCKED'"
CHANNEL = "CASE WHEN mainline THEN 'MAINLINE' WHEN setup IN ('BREAKOUT', 'PULLBACK') THEN setup ELSE 'NORMAL' END"
TREND = f"CASE WHEN weekly_score >= {FLOOR} THEN 'BULL' WHEN weekly_score <= -0.25 THEN 'BEAR' ELSE 'NEUTRAL' END"
#: The rows that serve as a baseline, whatever their calibration.
BASELINE = "weekly_score >= 0.25 AND monthly_score >= -0.15 AND setup IN ('BREAKOUT', 'PULLBACK') AND setup_score >= 55.0 AND executable AND priority >= 55.0"
#: Inputs of the calibration, all about the size of one.
FEATURES = {
    "f_monthly": "monthly_score",
    "f_weekly": "weekly_score",
    "f_setup": "setup_score / 100",
    "f_relative": "relative_strength / 100",
    "f_risk": "risk_quality / 100",
    "f_market": "market_score",
    "f_breakout": "CASE WHEN setup = 'BREAKOUT' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "f_adaptive": "adaptive_score / 100",
}
NULLS = {"relative_strength": 0.0, "risk_quality": 0.0, "market_score": 0.0, "adaptive_score": 50.0, "monthly_score": 0.0, "weekly_score": 0.0, "setup_score": 0.0, "priority": 0.0, **DEFAULTS}
FLAGS = ["history_ok", "has_120", "executable", "approved", "target"]
WORDS = {"setup": "NONE", "quality": "", "permission": "BLOCKED"}


def reason_list(rules: list[tuple[str, str]]) -> str:
    """Names of the rules that hold, joined by commas, as an expression of either engine."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in rules) + ")"


def steps() -> list[dict[str, str]]:
    """Expressions from the inputs of a signal to its state; each step reads what the one before made."""
    known = {k: f"coalesce(CAST({k} AS DOUBLE), {v})" for k, v in NULLS.items()}
    cut = {k: f"greatest(CAST({low} AS DOUBLE), least(CAST({high} AS DOUBLE), {known.get(k, k)}))" for k, (low, high) in RANGES.items()}
    return [
        {**known, **cut, **{k: f"coalesce({k}, false)" for k in FLAGS}, **{k: f"coalesce({k}, '{v}')" for k, v in WORDS.items()}},
        {"mainline": MAINLINE},
        {"reasons": reason_list(REASONS), "channel": CHANNEL, "trend": TREND, "baseline": BASELINE, **FEATURES},
        {"state": f"CASE WHEN {BLOCKED} THEN 'BLOCKED' WHEN reasons = '' THEN 'READY' ELSE 'WATCH' END"},
    ]


def signal_states(df: DataFrame) -> DataFrame:
    """Add mainline, reasons, channel, trend, baseline, the calibration features and state to rows of inputs.

    Inputs that are null count as NULLS, WORDS or false: a signal without a calibration or a market is blocked.
    """
    for step in steps():
        df = df.withColumns({k: F.expr(e) for k, e in step.items()})
    return df


#: Least new dates under one policy, days that a retired factor stays out.
SEASONING_DATES, COOL_DOWN = 13, 183
ENSEMBLE = "ic_observations >= 3 AND ic_mean >= 0.015 AND ic_ir >= 0.15 AND recent_ic_mean >= 0.005 AND status <> 'RETIRED' AND turnover <= 0.85"
SEASONED = f"same_policy AND NOT changed AND unseen_dates >= {SEASONING_DATES}"
#: Reasons against an approval, in their order. Null counts as not met.
APPROVAL = [
    ("POLICY_SEASONING_INCOMPLETE", f"NOT coalesce({SEASONED}, false)"),
    ("POLICY_CANDIDATE_SPEC_CHANGED_RESET_SEASONING", "coalesce(changed, false)"),
    ("FACTOR_SELECTION_GATE_FAILED", "NOT coalesce(selected, false)"),
    ("EFFECTIVE_FACTOR_COUNT_BELOW_2", "coalesce(factors, 0) < 2"),
    ("INDEPENDENT_ENSEMBLE_HOLDOUT_GATE_FAILED", f"NOT coalesce({ENSEMBLE}, false)"),
]


def approval(df: DataFrame) -> DataFrame:
    """Add reasons and approved to rows of same_policy, changed, unseen_dates, selected, factors and the ensemble's metrics."""
    return df.withColumn("reasons", F.expr(reason_list(APPROVAL))).withColumn("approved", F.col("reasons") == "")


def retirements(before: DataFrame, after: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """One row a factor that left or entered: factor, event (RETIRED, REPLACEMENT), reasons and the last day of its cool-down.

    before and after: factor; found: factor and reasons (of those that failed); a factor that left without a reason was
    outperformed. Both sets are joined by name, so a factor in both gives no row.
    """
    left = before.select("factor").distinct().withColumn("was", F.lit(True))
    right = after.select("factor").distinct().withColumn("stays", F.lit(True))
    rows = left.join(right, "factor", "full").where("was IS NULL OR stays IS NULL").join(found.groupBy("factor").agg(F.max("reasons").alias("reasons")), "factor", "left")
    gone = F.col("stays").isNull()
    return rows.select(
        "factor",
        F.when(gone, "RETIRED").otherwise("REPLACEMENT").alias("event"),
        F.when(gone, F.coalesce(F.when(F.col("reasons") != "", F.col("reasons")), F.lit("OUTPERFORMED_BY_REPLACEMENT"))).alias("reasons"),
        F.when(gone, F.date_add(F.lit(on).cast("date"), COOL_DOWN)).alias("cooldown_until"),
    )
