"""Model choice, due calibrations, triggers, readiness and predictions against literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from panelmill.operators import governance as G


def test_choice(spark):
    schema = "i int, c_excess_return double, c_information_ratio double, c_max_drawdown double, i_excess_return double, i_information_ratio double, i_max_drawdown double, i_fingerprint string, fingerprint string"
    rows = [
        (0, None, 1.0, 0.1, 0.1, 1.0, 0.1, "", ""),
        (1, 0.1, 1.0, 0.1, None, None, None, "", ""),
        (2, 0.1, 1.0, 0.1, 0.2, 1.0, 0.1, "a", "b"),
        (3, 0.1, 1.0, 0.1, 0.2, 0.5, 0.1, "a", "a"),
        (4, 0.2, 1.0, 0.1, 0.2, 0.5, 0.1, "a", ""),
        (5, 0.2, 1.0, 0.1, 0.2, 1.0, 0.05, "", "b"),
        (6, 0.2, 1.0, 0.1, 0.2, 1.0, 0.1, "", ""),
    ]
    got = [(r["reason"], r["selected"]) for r in G.choose_models(spark.createDataFrame(rows, schema)).orderBy("i").collect()]
    assert got == [
        ("CANDIDATE_PERFORMANCE_EVIDENCE_INVALID", False),
        ("CANDIDATE_FIRST_NO_COMPARABLE_INCUMBENT", True),
        ("FORCED_PROMOTION_INCUMBENT_FINGERPRINT_STALE", True),
        ("INCUMBENT_BETTER_EXCESS_RETURN", False),
        ("CANDIDATE_BETTER_INFORMATION_RATIO", True),
        ("INCUMBENT_BETTER_MAX_DRAWDOWN", False),
        ("CANDIDATE_FIRST_PERFORMANCE_TIE", True),
    ]


def test_due_and_triggers(spark):
    schema = "present boolean, age int, lag int, cutoff string, expected string, found string, policy string, current_policy string"
    rows = [(False, None, None, None, None, None, None, "p"), (True, 14, 53, "d", "x", "x", "p", "p"), (True, 15, 54, "d", "x", "y", "q", "p"), (True, -1, 0, None, "x", "x", None, "p")]
    got = [r["due"] for r in G.calibration_due(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got == ["MISSING", "", "GENERATED_TOO_OLD,TRAINED_TOO_OLD,DATA_FINGERPRINT_MISMATCH,FACTOR_EVOLUTION_POLICY_MISMATCH", "GENERATED_AT_IN_FUTURE,FINGERPRINT_AUTHORITY_MISSING,FACTOR_EVOLUTION_POLICY_MISMATCH"]
    health = spark.createDataFrame([(True, "SUSPENDED", False, 7, "A", "STRUCTURAL"), (True, "SUSPENDED", False, 7, "B", "STATISTICAL"), (True, "SUSPENDED", True, 7, "C", "STATISTICAL"), (True, "SUSPENDED", True, 6, "D", "STRUCTURAL"), (True, "WATCH", True, 9, "E", "STRUCTURAL"), (False, "SUSPENDED", True, 9, "F", "STRUCTURAL")], "approved boolean, status string, mature boolean, age int, reason string, kind string")
    assert sorted(r["trigger"] for r in G.health_triggers(health).collect()) == ["FACTOR_LIVE_HEALTH_HARD_FAILURE:A", "FACTOR_LIVE_HEALTH_HARD_FAILURE:C"]


def test_readiness(spark):
    both = "POLICY_SEASONING_INCOMPLETE,FACTOR_SELECTION_GATE_FAILED"
    rows = [(False, True, True, ""), (True, True, True, ""), (True, False, True, both), (True, False, True, "POLICY_SEASONING_INCOMPLETE"), (True, False, True, "FACTOR_SELECTION_GATE_FAILED"), (True, False, True, "INDEPENDENT_ENSEMBLE_HOLDOUT_GATE_FAILED"), (True, False, True, "EFFECTIVE_FACTOR_COUNT_BELOW_2"), (True, True, False, "")]
    got = [r["readiness"] for r in G.readiness(spark.createDataFrame(rows, "identity_match boolean, approved boolean, live_ok boolean, reasons string").coalesce(1)).collect()]
    assert got == [name for name, _ in G.READINESS] + ["LIVE_HEALTH_NOT_APPROVED"]


def test_predictions_and_priorities(spark):
    model = {"features": ["a", "b"], "mean": [1.0, 2.0], "scale": [2.0, 0.0], "early_stop": [0.0, 1.0, 0.0], "win": [100.0, 0.0, 0.0], "excess": [0.5, 1.0, 2.0], "samples": 100}
    row = G.predict(spark.createDataFrame([(3.0, None)], "a double, b double"), model).first()
    assert row["early_stop"] == pytest.approx(1 / (1 + math.exp(-1)), abs=1e-6) and row["win"] == 1.0 and row["confidence"] == "HIGH"
    assert row["excess"] == pytest.approx(0.5 + 1 - 4)
    rows = spark.createDataFrame([(60.0, 80.0, True), (60.0, 80.0, False)], "priority double, adaptive_score double, approved boolean").coalesce(1)
    assert [r[0] for r in rows.select(F.expr(G.blended_priority())).collect()] == [63.0, 60.0]
    assert rows.select(F.expr(G.blended_priority(0.9))).first()[0] == pytest.approx(0.65 * 60 + 0.35 * 80)
