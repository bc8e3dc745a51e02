"""Scans, unfinished and confirmed periods, signal sessions, and heads fitted over folds, against plain arithmetic."""

import math
from datetime import date, timedelta

import numpy as np
import pytest

from panelmill.functions import scans
from panelmill.operators import calibration as K
from panelmill.operators import labels as L
from panelmill.operators import panel as P

BARS = "code string, date date, open double, high double, low double, close double, volume double"


def weekdays(n, start=date(2020, 1, 1)):
    out = []
    while len(out) < n:
        if start.weekday() < 5:
            out.append(start)
        start += timedelta(days=1)
    return out


def series(n, code="A", seed=1):
    rng = np.random.default_rng(seed)
    close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [(code, d, float(c * 0.99), float(c * 1.02), float(c * 0.97), float(c), 1e6) for d, c in zip(weekdays(n), close, strict=True)]


def ewm(values, weight):
    out = [values[0]]
    for v in values[1:]:
        out.append(out[-1] * (1 - weight) + v * weight)
    return out


def rolled(rows, key):
    """Bars of the periods of rows in order, the last one unfinished."""
    out = {}
    for _, d, o, h, low, c, _ in rows:
        k = key(d)
        out[k] = (out[k][0], max(out[k][1], h), min(out[k][2], low), c) if k in out else (o, h, low, c)
    return list(out.values())


def week_score(rows):
    bars = rolled(rows, lambda d: d - timedelta(days=d.weekday()))
    if len(bars) < 21:
        return 0.0
    close = [b[3] for b in bars]
    tr = [b[1] - b[2] if i == 0 else max(b[1] - b[2], abs(b[1] - close[i - 1]), abs(b[2] - close[i - 1])) for i, b in enumerate(bars)]
    mean, atr = ewm(close, 2 / 21), ewm(tr, 1 / 14)[-1]
    path = sum(abs(a - b) for a, b in zip(close[-13:], close[-14:-1], strict=True))
    score = 0.40 * math.tanh((close[-1] - mean[-1]) / atr / 2) + 0.35 * math.tanh(math.log(mean[-1] / mean[-5]) / (4 * max(atr / close[-1], 0.005)))
    return round(max(-1, min(1, score + 0.25 * max(-1, min(1, (close[-1] - close[-14]) / path)))), 6)


def month_score(rows):
    close = [b[3] for b in rolled(rows, lambda d: (d.year, d.month))]
    if len(close) < 13:
        return 0.0
    mean = ewm(close, 2 / 11)
    return round(max(-1, min(1, 0.55 * math.tanh(math.log(close[-1] / mean[-1]) / 0.08) + 0.45 * math.tanh(math.log(mean[-1] / mean[-4]) / 0.06))), 6)


def test_scan_equals_a_loop(spark):
    rows = series(300) + series(7, "B", 2)
    got = scans.smoothed(spark.createDataFrame(rows, BARS), {"e": ("close", 0.1), "h": ("high", 0.5)}, "close", "high").collect()
    for code in "AB":
        mine = sorted((r["date"], r["e"], r["h"]) for r in got if r["code"] == code)
        assert [m[1] for m in mine] == pytest.approx(ewm([r[5] for r in rows if r[0] == code], 0.1), rel=1e-12)
        assert [m[2] for m in mine] == pytest.approx(ewm([r[3] for r in rows if r[0] == code], 0.5), rel=1e-12)
    assert scans.exponential_means([None, 1.0, None, 3.0], 0.5) == [None, 1.0, 1.0, 2.0]


def test_unfinished_periods_equal_a_roll_up_of_the_rows_so_far(spark):
    rows = series(330)
    df = spark.createDataFrame(rows, BARS)
    weeks = {r["date"]: r["week_score"] for r in P.week_scores(df).collect()}
    months = {r["date"]: r["month_score"] for r in P.month_scores(df).collect()}
    for i in [5, 99, 100, 101, 104, 150, 262, 263, 264, 275, 300, 329]:
        assert weeks[rows[i][1]] == pytest.approx(week_score(rows[: i + 1]), abs=2e-6)
        assert months[rows[i][1]] == pytest.approx(month_score(rows[: i + 1]), abs=2e-6)


def test_scores_are_confirmed_by_the_last_session_of_a_period(spark):
    rows = series(140)
    df = spark.createDataFrame(rows, BARS)
    confirmed = {r["date"]: r["week_score"] for r in P.confirmed_on(P.week_scores(df), "week_score", df.select("date"), "week").collect()}
    fridays = [i for i, r in enumerate(rows) if r[1].weekday() == 4]
    assert all(confirmed[rows[i][1]] == pytest.approx(week_score(rows[: i + 1]), abs=2e-6) for i in fridays[-4:])
    assert all(d.weekday() == 4 or d == rows[-1][1] for d in confirmed)


def test_a_signal_session_sees_the_last_bar_so_far(spark):
    days = weekdays(400)
    sessions = P.signal_sessions(spark.createDataFrame([(d,) for d in days], "date date"))
    signals = [days[k] for k in range(252, 400 - 21, 5)]
    assert sorted(r["date"] for r in sessions.where("signal").collect()) == signals
    missing = {260, 261, 262, 263, 264, 265, 266, 267, 268, 269, 300}
    kept = [d for i, d in enumerate(days) if i not in missing]
    bars = spark.createDataFrame([("A", d, i + 1, len(kept)) for i, d in enumerate(kept)], "code string, date date, n int, m int")
    got = {r["signal_date"]: r["date"] for r in P.at_signals(bars, sessions).collect()}
    assert got == {s: max(d for d in kept if d <= s) for s in signals if sum(d <= s for d in kept) >= 252 and sum(d > s for d in kept) >= 21}
    assert got[days[267]] == days[259] == got[days[262]]


def heads_rows(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 0.2, 5] + [0, 3, -1]
    z = x @ [0.8, -1.5, 0.1] + 4
    days = [date(2019, 1, 1) + timedelta(days=int(k)) for k in np.sort(rng.integers(0, 1900, n))]
    early, win = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int), (rng.random(n) < 1 / (1 + np.exp(z / 2))).astype(int)
    excess = 0.02 * x[:, 0] + rng.normal(0, 0.1, n)
    return [(d, *map(float, r), 7.0, int(e), int(w), float(g)) for d, r, e, w, g in zip(days, x, early, win, excess, strict=True)]


def test_heads_of_all_folds_equal_fits_of_their_rows(spark):
    rows = heads_rows()
    features = ["a", "b", "c", "flat"]
    df = spark.createDataFrame(rows, "date date, a double, b double, c double, flat double, early_stop int, win_10d int, excess_10d double")
    folds = L.walk_forward_folds(min(r[0] for r in rows), max(r[0] for r in rows))
    models = K.fit_heads(df, folds, features)
    assert [m.fold for m in models] == [f[0] for f in folds] and len(folds) >= 4
    for m, (_, begin, end, *_) in zip(models, folds, strict=True):
        mine = [r for r in rows if begin <= r[0] < end]
        x = np.array([r[1:5] for r in mine])
        assert m.rows == len(mine) and m.mean == pytest.approx(x.mean(axis=0)) and m.scale[:3] == pytest.approx(x[:, :3].std(axis=0)) and m.scale[3] == 1
        z = (x - m.mean) / m.scale
        for head, at in (("early_stop", 5), ("win", 6)):
            assert m.heads[head] == pytest.approx(L.fit_logistic(z, np.array([r[at] for r in mine], dtype=float)), abs=1e-5)
        design, y = np.column_stack((np.ones(len(z)), z)), np.clip([r[7] for r in mine], -0.15, 0.15)
        assert m.heads["excess"] == pytest.approx(np.linalg.solve(design.T @ design + np.diag([0, 1, 1, 1, 1]), design.T @ y), abs=1e-9)
    scored = K.predict_folds(df, folds, models, features).collect()
    assert len(scored) == sum(any(f[3] <= r[0] < f[4] for f in folds) for r in rows)
    one = scored[-1]
    m = next(m for m in models if m.fold == one["fold"])
    z = np.array([1.0, *((np.array([one[f] for f in features]) - m.mean) / m.scale)])
    assert one["win"] == pytest.approx(1 / (1 + math.exp(-z @ m.heads["win"])), abs=1e-6) and one["excess"] == pytest.approx(z @ m.heads["excess"], abs=1e-8)


def test_empty_and_null_rows_have_defined_results(spark):
    df = spark.createDataFrame([], "date date, a double, early_stop int, win_10d int, excess_10d double")
    folds = L.walk_forward_folds(date(2019, 1, 1), date(2023, 1, 1))
    assert K.fit_heads(df, folds, ["a"]) == [] and K.fit_heads(df, [], ["a"]) == []
    assert K.predict_folds(df, folds, [], ["a"]).count() == 0
    one = spark.createDataFrame([(date(2019, 5, 1), None, None, 1, None), (None, 1.0, 1, 1, 1.0)], df.schema)
    models = K.fit_heads(one, folds, ["a"])
    assert {m.rows for m in models} == {1} and all(np.isfinite(w).all() for m in models for w in m.heads.values())
