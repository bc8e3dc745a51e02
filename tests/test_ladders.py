"""Rule scores against literal cases and against plain Python over a path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import ladders as L

MONTH = "close double, ma5 double, ma10 double, ma20 double, slope5 double, slope20 double, h0 double, h1 double, close3 double, close6 double"
WEEK = "open double, high double, close double, volume double, vma double, ma5 double, ma10 double, ma20 double, slope5 double, slope10 double, slope20 double, h0 double, high12 double, low12 double, high12p double, low12p double"


def test_month(spark):
    rows = [
        (10.0, 9.0, None, None, 4.0, None, 0.1, None, 9.0, None),  # thin, rising
        (105.0, 104.0, 100.0, 95.0, 2.0, 1.0, 0.5, 0.4, 100.0, 96.0),  # 3.8 + 0.48 + 0.25 + 0.5
        (90.0, 92.0, 95.0, 99.0, -2.0, -1.0, -0.5, -0.4, 95.0, 99.0),  # -3.8 - 0.379 - 0.263 - 0.5
        (130.0, 104.0, 100.0, 95.0, 2.0, 1.0, 0.5, 0.6, 130.0, 131.0),  # 2.0 - 1.0
        (100.0, 101.0, 102.0, 100.0, 0.0, 0.0, 0.3, 0.2, 100.0, 100.0),  # below its means, histogram up
    ]
    got = [(r["rule"], r["score"]) for r in L.scored(spark.createDataFrame(rows, MONTH), "month").collect()]
    assert got == [("THIN_UP", 1.5), ("ADVANCE", 5.0), ("DECLINE", -4.9), ("BULL", 1.0), ("BOTTOMING", -0.5)]


def test_week(spark):
    base = dict(open=100.0, high=104.0, close=103.0, volume=130.0, vma=100.0, ma5=101.0, ma10=100.0, ma20=98.0, slope5=0.5, slope10=0.3, slope20=0.6, h0=0.2, high12=104.0, low12=90.0, high12p=103.0, low12p=90.0)
    cases = [
        ({}, "BREAKOUT_STRONG", 6.0),
        ({"slope20": 0.4}, "BREAKOUT", 4.8),
        ({"high12p": 110.0}, "ADVANCE", 5.6),
        ({"high12p": 110.0, "close": 115.0, "high": 105.0, "h0": 0.1, "volume": 100.0, "high12": 140.0}, "ADVANCE_FAR", 4.6),
        ({"high": 110.0, "high12p": 110.0, "close": 104.0}, "FAILED_ABOVE", 1.0),
        ({"ma20": None}, "THIN", 0.0),
        ({"close": 90.0, "ma5": 92.0, "ma10": 95.0, "slope5": -1.0, "slope10": -0.5, "slope20": -1.0, "h0": -0.2, "high12p": 120.0}, "DOWN_EXTREME", -6.0),
    ]
    rows = [tuple({**base, **change}[c.split()[0]] for c in WEEK.split(", ")) for change, _, _ in cases]
    got = L.scored(spark.createDataFrame(rows, WEEK), "week").select("rule", "score").collect()
    assert [tuple(r) for r in got[:3]] == [c[1:] for c in cases[:3]]
    assert [tuple(r) for r in got[4:]] == [c[1:] for c in cases[4:]]
    assert got[3]["rule"] in ("BREAKOUT", "ADVANCE_FAR")  # above 115 * 0.995 without volume it is no breakout
    assert got[3]["score"] == 4.6


def test_inputs_of_a_path(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 70)))
    bars = pd.DataFrame({"code": "a", "date": pd.bdate_range("2020-01-01", periods=70).date, "open": close * 0.99, "high": close * 1.02, "low": close * 0.97, "close": close, "volume": rng.integers(50, 90, 70).astype(float)})
    short = bars.head(3).assign(code="b")
    got = {r["code"]: r for r in L.inputs(spark.createDataFrame(pd.concat([bars, short])), "day").collect()}
    c = bars["close"]
    dif = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    hist = dif - dif.ewm(span=9, adjust=False).mean()
    tr = np.maximum(bars["high"], c.shift().fillna(0)) - np.minimum(bars["low"], c.shift().fillna(np.inf))
    delta = c.diff().fillna(0)
    up, down = (delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-delta).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean())
    want = {"ma20": c.tail(20).mean(), "h0": hist.iloc[-1], "h3": hist.iloc[-4], "sd20": c.tail(20).std(), "atr": tr.tail(14).mean(), "rsi": 100 - 100 / (1 + up.iloc[-1] / down.iloc[-1]), "vma": bars["volume"].tail(20).mean(), "high20p": bars["high"].iloc[-21:-1].max(), "high_a": c.iloc[-30:-15].max(), "low_z_h": hist.iloc[-15:].loc[c.iloc[-15:].idxmin()]}
    for name, value in want.items():
        assert got["a"][name] == pytest.approx(value, abs=1e-6), name
    assert np.sign(got["a"]["price_slope"]) == np.sign(np.polyfit(range(6), c.tail(6), 1)[0])
    assert got["b"]["ma5"] is None and got["b"]["high20p"] is None and got["b"]["h3"] is None


def test_short_histories_have_a_score(spark):
    bars = spark.createDataFrame([("a", i, 10.0, 11.0, 9.0, 10.5, 5.0) for i in range(2)], "code string, date int, open double, high double, low double, close double, volume double")
    for unit, rule in (("day", "NO_BAND"), ("week", "THIN"), ("month", "THIN")):
        row = L.scored(L.inputs(bars, unit), unit).first()
        assert (row["rule"], row["score"]) == (rule, 0.0)
        assert L.scored(L.inputs(bars.where(F.lit(False)), unit), unit).count() == 0
