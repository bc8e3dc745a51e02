"""Signal states, approvals and retirements against literal cases."""

from datetime import date

from panelmill.operators import signals as S

SCHEMA = "code string, quality string, permission string, setup string, setup_score double, monthly_score double, weekly_score double, relative_strength double, priority double, risk_quality double, market_score double, adaptive_score double, history_ok boolean, has_120 boolean, executable boolean, approved boolean, target boolean, early_stop double, win double, excess double, early_stop_max double, priority_min double, setup_min double"
GOOD = ("VALID", "ALLOWED", "BREAKOUT", 80.0, 0.3, 0.7, 85.0, 78.0, 50.0, 0.4, None, True, True, True, True, False, 0.1, 0.6, 0.02, None, None, None)


def _states(spark, *changes):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple({**dict(zip(names[1:], GOOD, strict=True)), "code": str(i), **change}[n] for n in names) for i, change in enumerate(changes)]
    return [(r["state"], r["channel"], r["trend"], r["reasons"]) for r in S.signal_states(spark.createDataFrame(rows, SCHEMA)).orderBy("code").collect()]


def test_signal_states(spark):
    got = _states(
        spark,
        {},
        {"priority": 60.0},
        {"permission": "MAINLINE_ONLY", "weekly_score": 0.5},
        {"approved": False},
        {"approved": False, "target": True, "weekly_score": -1.0, "setup": "NONE"},
        {"quality": "DEGRADED", "history_ok": False, "monthly_score": -1.0, "weekly_score": 0.4},
        {"permission": None, "early_stop": None, "excess": None},
    )
    assert got == [
        ("READY", "MAINLINE", "BULL", ""),
        ("WATCH", "BREAKOUT", "BULL", "PRIORITY_BELOW_THRESHOLD"),
        ("WATCH", "BREAKOUT", "BULL", "MARKET_MAINLINE_ONLY"),
        ("BLOCKED", "MAINLINE", "BULL", "CALIBRATION_NOT_APPROVED"),
        ("READY", "NORMAL", "BEAR", ""),
        ("WATCH", "BREAKOUT", "NEUTRAL", "DATA_QUALITY_NOT_VALID,WEEKLY_TREND_NOT_CONFIRMED"),
        ("BLOCKED", "MAINLINE", "BULL", "MARKET_BLOCKED,EARLY_STOP_RISK_HIGH,EXPECTED_EXCESS_NOT_POSITIVE"),
    ]


def test_approval(spark):
    schema = "i int, same_policy boolean, changed boolean, unseen_dates int, selected boolean, factors int, ic_observations int, ic_mean double, ic_ir double, recent_ic_mean double, status string, turnover double"
    good = (True, False, 13, True, 2, 3, 0.015, 0.15, 0.005, "ACTIVE", 0.85)
    rows = [(0, *good), (1, True, False, 12, *good[3:]), (2, *good[:4], 1, *good[5:]), (3, *good[:9], "RETIRED", 0.1), (4, *([None] * 11)), (5, True, True, *good[2:])]
    got = {r["i"]: (r["approved"], r["reasons"]) for r in S.approval(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == (True, "") and got[1] == (False, "POLICY_SEASONING_INCOMPLETE") and got[2] == (False, "EFFECTIVE_FACTOR_COUNT_BELOW_2")
    assert got[3] == (False, "INDEPENDENT_ENSEMBLE_HOLDOUT_GATE_FAILED")
    assert got[4][1].split(",") == ["POLICY_SEASONING_INCOMPLETE", "FACTOR_SELECTION_GATE_FAILED", "EFFECTIVE_FACTOR_COUNT_BELOW_2", "INDEPENDENT_ENSEMBLE_HOLDOUT_GATE_FAILED"]
    assert got[5][1] == "POLICY_SEASONING_INCOMPLETE,POLICY_CANDIDATE_SPEC_CHANGED_RESET_SEASONING"


def test_retirements(spark):
    before, after = (spark.createDataFrame([(x,) for x in names], "factor string") for names in ("abc", "cd"))
    found = spark.createDataFrame([("a", "DECAY"), ("c", "WEAK"), ("b", "")], "factor string, reasons string")
    rows = {r["factor"]: tuple(r)[1:] for r in S.retirements(before, after, found, "2020-01-01").collect()}
    assert rows == {"a": ("RETIRED", "DECAY", date(2020, 7, 2)), "b": ("RETIRED", "OUTPERFORMED_BY_REPLACEMENT", date(2020, 7, 2)), "d": ("REPLACEMENT", None, None)}
