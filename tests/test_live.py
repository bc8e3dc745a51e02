"""Live performance: records carried from run to run, verdicts, merged histories, states by epoch."""

from datetime import date, timedelta

import pytest

from panelmill.operators import live as L
from panelmill.sources import files as S

HISTORY = "code string, date date, strategy_nav double, benchmark_nav double, relative_nav double, model string, evidence string"
MODELS = "code string, model string, generated date, today date, expected date"
DAY = date(2024, 1, 1)


def _path(code, navs, model="v2", evidence="BROKER_RECONCILED", start=0):
    return [(code, DAY + timedelta(start + i), float(v), 1.0, float(v), model, evidence) for i, v in enumerate(navs)]


def _base(spark, codes, nav=1.0):
    return spark.createDataFrame([(c, nav) for c in codes], "code string, nav double")


def _model(code, today=DAY + timedelta(100), generated=DAY, expected=None, model="v2"):
    return (code, model, generated, today, expected)


def test_what_breaks_continuity(spark):
    one = _path("a", [1, 1.01, 1.02])
    first = L.records(L.observations(spark.createDataFrame(one, HISTORY)), _base(spark, "a"))

    def found(rows, nav=1.0, before=first):
        got = L.continuity(L.observations(spark.createDataFrame(rows, HISTORY)), _base(spark, "a", nav), before).first()
        return [f.removeprefix("LIVE_PERFORMANCE_") for f in got["findings"]]

    more = _path("a", [1.03], start=3)
    assert found(one + more) == [] and found(one) == []
    assert found(one + more, nav=2.0) == ["BASELINE_RESET"]
    assert found(one[:2]) == ["OBSERVATION_COUNT_ROLLBACK", "HISTORY_DATE_ROLLBACK"]
    assert found(one[1:]) == ["OBSERVATION_COUNT_ROLLBACK"]
    changed = [(*one[2][:6], "UNKNOWN")]
    assert found(one[:2] + changed + more) == ["HISTORY_CONTINUITY_BROKEN"]
    assert found(one[:2] + changed) == []  # no later day yet
    assert found(one[:2] + [(*one[2][:6], "LEGACY_UNVERIFIED")] + more) == []  # replaced by a reconciled record
    assert found(one[:2] + more + _path("a", [1.04], start=4)) == ["HISTORY_CONTINUITY_BROKEN"]  # the day is gone
    assert found(one + one[2:]) == ["DATES_INVALID"]
    assert found(one + [("a", None, 1.0, 1.0, 1.0, "v2", None)]) == ["DATES_INVALID"]
    assert found(_path("a", [1, 1.01, 1.02, 0])) == ["NAV_INVALID"]
    assert found(_path("a", [1, 1.01, 1.02, float("nan")])) == ["NAV_INVALID"]
    assert found(one, nav=2.0, before=None) == []


CASES = {
    "risk": (_path("x", [1, 1.2, 1.01]), {}, "LIVE_RISK_LIMIT_BREACH", False, True),
    "risk_cooling": (_path("x", [1, 1.2, 1.01]), {"generated": DAY + timedelta(94)}, "LIVE_RISK_LIMIT_BREACH", False, False),
    "soft": (_path("x", [1.0] * 5 + [0.949] * 16), {}, "LIVE_MODEL_RECALIBRATION_REQUIRED", True, True),
    "few": (_path("x", [1.0] * 19), {}, "WARMUP", True, False),
    "enough": (_path("x", [1.0] * 20), {}, "ACTIVE", True, False),
    "unseen": ([], {}, "NO_LIVE_PERFORMANCE_EVIDENCE", True, False),
    "missed": ([], {"expected": DAY + timedelta(98)}, "LIVE_PERFORMANCE_SESSION_MISSED", False, False),
    "in_grace": ([], {"expected": DAY + timedelta(99)}, "NO_LIVE_PERFORMANCE_EVIDENCE", True, False),
    "other_model": (_path("x", [1.0] * 30, model="v1"), {}, "WARMUP_CURRENT_MODEL_NOT_OBSERVED", True, False),
    "wrong_session": (_path("x", [1.0] * 30, model="v1"), {"expected": DAY + timedelta(29)}, "LIVE_PERFORMANCE_MODEL_SESSION_MISMATCH", False, False),
    "later_session": (_path("x", [1.0] * 30, model="v1"), {"expected": DAY + timedelta(30)}, "WARMUP_CURRENT_MODEL_NOT_OBSERVED", True, False),
    "pending": (_path("x", [1.0] * 30, evidence="MODEL_ESTIMATE_PENDING"), {"expected": DAY, "today": DAY}, "LIVE_PERFORMANCE_BROKER_RECONCILIATION_PENDING", True, False),
    "not_final": (_path("x", [1.0] * 30, evidence=None), {"expected": DAY}, "LIVE_PERFORMANCE_STATE_EVIDENCE_NOT_FINAL", False, False),
    "broken": (_path("x", [1.0, -1.0]), {}, "LIVE_PERFORMANCE_EVIDENCE_REJECTED", False, False),
    # Falls before the current model's run don't count.
    "suffix": (_path("x", [2.0] * 5, model="v1") + _path("x", [1.0] * 20, start=5), {}, "ACTIVE", True, False),
    "below_the_limit": (_path("x", [100.0, 89.9]), {}, "LIVE_RISK_LIMIT_BREACH", False, True),
    # 90 / 100 - 1 is a little above -0.1 in doubles; limits are compared before rounding.
    "at_the_limit": (_path("x", [100.0, 90.0]), {}, "WARMUP", True, False),
    "long_return": (_path("x", [1.0] * 2 + [0.93] * 40 + [0.919] * 19), {}, "LIVE_MODEL_RECALIBRATION_REQUIRED", True, True),
}


def test_verdicts(spark):
    history, models = [], []
    for code, (rows, model, *_) in CASES.items():
        history += [(code, *r[1:]) for r in rows]
        models.append(_model(code, **model))
    got = L.audit(spark.createDataFrame(history, HISTORY), _base(spark, list(CASES)), spark.createDataFrame(models, MODELS)).collect()
    found = {r["code"]: (r["status"], r["allowed"], r["recalibrate"]) for r in got}
    assert found == {code: tuple(case[2:]) for code, case in CASES.items()}
    by_code = {r["code"]: r for r in got}
    assert by_code["soft"]["return_20"] == pytest.approx(-0.051) and by_code["soft"]["return_60"] is None
    assert by_code["risk"]["own_fall"] == pytest.approx(1.01 / 1.2 - 1, abs=1e-8)
    assert by_code["suffix"]["current"] == 20 and by_code["unseen"]["current"] == 0


def test_two_runs_and_a_repeated_one(spark, tmp_path):
    """The record of each run is kept by epoch; a repeated run compares with the one before it, not with itself."""
    folder, rows = str(tmp_path / "state"), _path("a", [1, 1.01, 1.02, 1.03])
    models = spark.createDataFrame([_model("a"), _model("b")], MODELS)

    def run(epoch, history, nav=1.0):
        found = L.audit(spark.createDataFrame(history, HISTORY), _base(spark, "a", nav), models, S.load_epoch(spark, folder, epoch))
        S.save_epoch(found, folder, epoch)
        return {r["code"]: [f.removeprefix("LIVE_PERFORMANCE_") for f in r["findings"]] for r in found.collect()}

    assert S.load_epoch(spark, folder, 1) is None
    assert run(1, rows[:2]) == {"a": [], "b": []}
    assert run(2, rows, nav=2.0) == run(2, rows, nav=2.0) == {"a": ["BASELINE_RESET"], "b": []}
    assert run(3, rows[:3], nav=2.0) == {"a": ["OBSERVATION_COUNT_ROLLBACK", "HISTORY_DATE_ROLLBACK"], "b": []}
    # A run that does not see the code keeps the record of the one before.
    assert run(4, _path("b", [1.0])) == {"a": [], "b": []}
    assert run(5, rows, nav=2.0) == {"a": [], "b": []}
    before = {r["code"]: r["observations"] for r in S.load_epoch(spark, folder, 5).collect()}
    assert before == {"a": 3, "b": 1}


def test_two_slices_give_the_history_of_one(spark):
    rows = [("a", DAY + timedelta(i), i) for i in range(40)] + [(None, DAY, 7), ("b", None, 1)]
    make = lambda r: spark.createDataFrame(r, "code string, day date, v int")
    stale = [(c, d, -1) if i >= 15 else (c, d, v) for i, (c, d, v) in enumerate(rows[:20])]
    empty = make([])
    one = L.merged_history(empty, make(rows), ["code"], "day", 30)
    two = L.merged_history(L.merged_history(empty, make(stale), ["code"], "day", 30), make(rows[15:]), ["code"], "day", 30)
    again = L.merged_history(two, make(rows[15:] + rows[15:]), ["code"], "day", 30)
    want = sorted(map(repr, [tuple(r) for r in one.collect()]))
    assert sorted(map(repr, [tuple(r) for r in two.collect()])) == sorted(map(repr, [tuple(r) for r in again.collect()])) == want
    assert one.columns == ["code", "day", "v"] and len(want) == 31
    assert L.merged_history(empty, empty, ["code"], "day").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], HISTORY)
    got = L.audit(none, _base(spark, "a"), spark.createDataFrame([_model("a")], MODELS)).collect()
    assert [(r["code"], r["status"]) for r in got] == [("a", "NO_LIVE_PERFORMANCE_EVIDENCE")]
    assert L.audit(none, _base(spark, "a"), spark.createDataFrame([], MODELS)).count() == 0
