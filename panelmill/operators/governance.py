"""Choice between models, reasons to calibrate again, readiness for promotion, predictions of fitted heads.

Rules are data: ordered (name, condition) that both Spark and the comparison SQL read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.signals import reason_list

EPSILON = 1e-12
#: Metrics by which a candidate (c_) and an incumbent (i_) are compared in turn, and which way is better.
COMPARED = [("excess_return", 1), ("information_ratio", 1), ("max_drawdown", -1)]
C_KNOWN, I_KNOWN = (" AND ".join(f"{p}_{m} IS NOT NULL" for m, _ in COMPARED) for p in "ci")
CHOICE = [
    ("CANDIDATE_PERFORMANCE_EVIDENCE_INVALID", f"NOT ({C_KNOWN})", False),
    ("CANDIDATE_FIRST_NO_COMPARABLE_INCUMBENT", f"NOT ({I_KNOWN})", True),
    ("FORCED_PROMOTION_INCUMBENT_FINGERPRINT_STALE", "i_fingerprint <> '' AND fingerprint <> '' AND fingerprint <> i_fingerprint", True),
    *[(f"{who}_BETTER_{m.upper()}", f"{sign} * ({a}_{m} - {b}_{m}) > {EPSILON}", who == "CANDIDATE") for m, sign in COMPARED for who, a, b in (("CANDIDATE", "c", "i"), ("INCUMBENT", "i", "c"))],
]
TIE = "CANDIDATE_FIRST_PERFORMANCE_TIE"


def choice_sql() -> dict[str, str]:
    """reason and selected, as expressions of either engine; the first rule that holds counts, a tie goes to the candidate."""
    return {
        "reason": "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c, _ in CHOICE) + f" ELSE '{TIE}' END",
        "selected": "CASE " + " ".join(f"WHEN {c} THEN {str(s).lower()}" for _, c, s in CHOICE) + " ELSE true END",
    }


def choose_models(pairs: DataFrame) -> DataFrame:
    """Add reason and selected to pairs of c_ and i_ metrics, i_fingerprint and fingerprint (of the data as they are now)."""
    return pairs.withColumns({k: F.expr(e) for k, e in choice_sql().items()})


#: Days after which a model is generated anew, and by which its training may lag.
GENERATED_DAYS, TRAINED_DAYS, RECALIBRATION_COOL_DOWN = 14, 53, 7
#: Reasons for a calibration, in their order. Inputs: present, age, lag (days), cutoff, expected and found fingerprints, policies.
DUE = [
    ("MISSING", "NOT present"),
    ("GENERATED_AT_IN_FUTURE", "present AND age < 0"),
    ("GENERATED_TOO_OLD", f"present AND age > {GENERATED_DAYS}"),
    ("TRAINED_TOO_OLD", f"present AND lag > {TRAINED_DAYS}"),
    ("FINGERPRINT_AUTHORITY_MISSING", "present AND (cutoff IS NULL OR coalesce(expected, '') = '')"),
    ("DATA_FINGERPRINT_MISMATCH", "present AND cutoff IS NOT NULL AND coalesce(expected, '') <> '' AND expected <> coalesce(found, '')"),
    ("FACTOR_EVOLUTION_POLICY_MISMATCH", "present AND coalesce(policy, '') <> current_policy"),
]


def calibration_due(models: DataFrame) -> DataFrame:
    """Add due, the reasons for a new calibration joined by commas (empty: none)."""
    return models.withColumn("due", F.expr(reason_list(DUE)))


def health_triggers(health: DataFrame) -> DataFrame:
    """Rows of a suspended, approved registry older than the cool-down with a reason that calls for a new calibration.

    health: approved, status, mature, age (days), reason, kind (STRUCTURAL, STATISTICAL or other). Statistical reasons
    count only with mature evidence. One row a reason.
    """
    hard = (F.col("kind") == "STRUCTURAL") | ((F.col("kind") == "STATISTICAL") & F.col("mature"))
    rows = health.where(F.col("approved") & (F.col("status") == "SUSPENDED") & (F.col("age") >= RECALIBRATION_COOL_DOWN) & hard)
    return rows.withColumn("trigger", F.concat(F.lit("FACTOR_LIVE_HEALTH_HARD_FAILURE:"), "reason"))


_WITHOUT = "reasons NOT LIKE '%{0}%'".format
SEASONED, SELECTED = _WITHOUT("POLICY_SEASONING_INCOMPLETE"), _WITHOUT("FACTOR_SELECTION_GATE_FAILED")
#: States of a promotion, in their order. Inputs: identity_match, approved, live_ok, reasons (of the approval).
READINESS = [
    ("LIVE_HEALTH_REGISTRY_MISMATCH", "NOT identity_match"),
    ("APPROVED_FOR_LIVE_OVERLAY", "approved AND live_ok"),
    ("WAITING_FOR_NEW_LABELLED_DATES_AND_STRONGER_CANDIDATES", f"NOT ({SEASONED}) AND NOT ({SELECTED})"),
    ("WAITING_FOR_POLICY_SEASONING", f"NOT ({SEASONED})"),
    ("STRONGER_CANDIDATES_REQUIRED", f"NOT ({SELECTED})"),
    ("INDEPENDENT_HOLDOUT_REJECTED", f"NOT ({_WITHOUT('INDEPENDENT_ENSEMBLE_HOLDOUT_GATE_FAILED')})"),
    ("INSUFFICIENT_EFFECTIVE_FACTOR_COUNT", f"NOT ({_WITHOUT('EFFECTIVE_FACTOR_COUNT_BELOW_2')})"),
]
READY = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in READINESS) + " ELSE 'LIVE_HEALTH_NOT_APPROVED' END"
NEXT = """CASE WHEN NOT identity_match THEN 'REGENERATE_LIVE_FACTOR_HEALTH_FOR_CURRENT_REGISTRY'
  WHEN approved AND live_ok THEN 'MONITOR_LIVE_FACTOR_HEALTH' ELSE 'KEEP_CURRENT_ROTATION_AND_REEVALUATE_AFTER_NEW_LABELLED_DATES' END"""


def readiness(registries: DataFrame) -> DataFrame:
    """Add readiness and next_action."""
    return registries.withColumns({"readiness": F.expr(READY), "next_action": F.expr(NEXT)})


#: Rows from which a sample counts as medium and as high confidence; where the logit is cut.
MEDIUM, HIGH, LOGIT = 30, 100, 35.0
CONFIDENCE = f"CASE WHEN samples >= {HIGH} THEN 'HIGH' WHEN samples >= {MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END"


def linear(features: list[str], mean: list[float], scale: list[float], weights: list[float]) -> Column:
    """Intercept and weights over standardised columns; a missing feature counts as 0 before it is standardised."""
    total = F.lit(float(weights[0]))
    for name, m, s, w in zip(features, mean, scale, weights[1:], strict=True):
        total = total + (F.coalesce(F.col(name), F.lit(0.0)) - m) / (s if abs(s) > 1e-8 else 1.0) * w
    return total


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-LOGIT), F.least(F.lit(LOGIT), z))))


def predict(rows: DataFrame, model: dict) -> DataFrame:
    """Add early_stop, win and excess of a fitted model (features, mean, scale, and weights by head), and its confidence."""
    head = lambda name: linear(model["features"], model["mean"], model["scale"], model[name])
    rows = rows.withColumns({"early_stop": F.round(sigmoid(head("early_stop")), 6), "win": F.round(sigmoid(head("win")), 6), "excess": F.round(head("excess"), 8), "samples": F.lit(model["samples"])})
    return rows.withColumn("confidence", F.expr(CONFIDENCE))


#: Share of the adaptive score in a priority, and its most.
ADAPTIVE_SHARE, MOST_SHARE = 0.15, 0.35


def blended_priority(share: float = ADAPTIVE_SHARE) -> str:
    """Priority with the adaptive score of an approved registry, as an expression of either engine; else the base as it is."""
    w = min(max(share, 0.0), MOST_SHARE)
    blend = f"{1 - w} * priority + {w} * adaptive_score"
    return f"CASE WHEN approved THEN round(greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), CAST({blend} AS DOUBLE))) + 1e-9, 2) ELSE priority END"
