"""Learners against plain arithmetic, rules against literal cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import events as E
from panelmill.operators import factors as R
from panelmill.operators import labels as L
from panelmill.operators import regime as G
from panelmill.operators import status as T
from panelmill.operators import trend as D


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(4)
    n = 900
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, -1]
    p = 1 / (1 + np.exp(-(0.5 + x[:, 0] - 0.2 * x[:, 1])))
    days = pd.date_range("2020-01-03", periods=60, freq="7D")
    return pd.DataFrame({"year": rng.integers(2020, 2022, n), "date": days[rng.integers(0, 60, n)].date, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "won": (rng.random(n) < p).astype(int), "ahead": 0.02 * x[:, 0] - 0.03 * x[:, 2] + rng.normal(0, 0.08, n)})


def test_logistic_fit_by_group(spark, panel):
    got = {(r["year"], r["term"]): r["weight"] for r in L.fit_by_group(spark.createDataFrame(panel), "year", ["a", "b", "c"], "won").collect()}
    for year, part in panel.groupby("year"):
        x = part[["a", "b", "c"]].to_numpy()
        want = L.fit_logistic((x - x.mean(0)) / x.std(0), part["won"].to_numpy(dtype=float))
        for term, w in zip(["intercept", "a", "b", "c"], want, strict=True):
            assert got[year, term] == pytest.approx(w, abs=2e-6)


def test_ridge_weights(spark, panel):
    got = {r["term"]: r["weight"] for r in L.ridge_weights(spark.createDataFrame(panel), ["a", "b", "c"], "ahead").collect()}
    x = panel[["a", "b", "c"]].to_numpy()
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    y = panel["ahead"].clip(-0.15, 0.15).to_numpy()
    dates = sorted(set(panel["date"]))
    w = 0.5 ** (np.array([len(dates) - 1 - dates.index(d) for d in panel["date"]]) / 52)
    root = np.sqrt(w / w.mean())[:, None]
    beta = np.maximum(np.linalg.solve((z * root).T @ (z * root) + np.diag([0, 2.0, 2, 2]), (z * root).T @ (y * root[:, 0]))[1:], 0)
    assert [got[k] for k in "abc"] == pytest.approx(beta, abs=1e-7) and beta[0] > 0 and beta[2] == 0
    assert got["intercept"] == pytest.approx(np.average(y - z[:, 1:] @ beta, weights=w), abs=1e-7)


def test_significance(spark):
    rows = spark.createDataFrame([(8, 8, 3.0), (10, 5, 0.0), (0, 0, -1.96), (60, 40, 5.0)], "n long, k long, t double")
    got = rows.select(R.sign_tail(F.col("n"), F.col("k")).alias("s"), R.two_sided_normal("t").alias("p")).collect()
    assert [r["s"] for r in got] == pytest.approx([1 / 256, 638 / 1024, 1.0, sum(math.comb(60, i) for i in range(40, 61)) / 2**60])
    assert [r["p"] for r in got] == pytest.approx([0.0026997961, 1.0, 0.0499957902, 5.733031e-07], rel=1e-6)


def test_factor_metrics_of_known_paths(spark):
    rows = [("good", h, t, 0.05 + 0.01 * (t % 3), t >= 14) for h in (5, 10, 20) for t in range(40)]
    rows += [("flips", h, t, 0.05 if t < 14 else -0.05, t >= 14) for h in (5, 10, 20) for t in range(40)]
    rows += [("young", h, t, 0.05, True) for h in (5, 10) for t in range(5)]
    turnover = spark.createDataFrame([("good", 0.3), ("flips", 0.9), ("young", 0.1)], "factor string, turnover double")
    got = {r["factor"]: r for r in R.factor_metrics(spark.createDataFrame(rows, "factor string, horizon int, date int, ic double, recent boolean"), turnover).collect()}
    assert got["good"]["status"] == "ACTIVE" and got["good"]["reasons"] == "" and got["good"]["p"] == 0.0 and got["good"]["positive"] == 1.0
    assert got["flips"]["status"] == "RETIRED" and got["flips"]["p"] == 1.0
    assert got["flips"]["reasons"] == "NEGATIVE_RECENT_IC,RECENT_IR_WEAK,EXCESSIVE_TURNOVER"
    assert got["young"]["reasons"] == "INSUFFICIENT_IC_HISTORY,FAST_DECAY" and got["young"]["status"] == "WATCH"


def test_weighted_quantile_against_a_walk(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(v), int(w)) for g in "ab" for v, w in zip(np.round(rng.lognormal(0, 3, 400), 2), rng.integers(1, 9, 400), strict=True)] + [("one", 5.0, 2), ("same", 1.0, 1), ("same", 1.0, 3)]
    for q in (0.1, 0.75, 1.0):
        got = {r["g"]: r["quantile"] for r in E.weighted_quantile(spark.createDataFrame(rows, "g string, v double, w long"), "g", "v", "w", q).collect()}
        for g in {r[0] for r in rows}:
            mine, total = sorted((v, w) for k, v, w in rows if k == g), 0
            for v, w in mine:
                total += w
                if total >= q * sum(x for _, x in mine):
                    break
            assert got[g] == v


def test_both_setups(spark):
    columns = "close double, open double, atr5 double, atr14 double, atr20 double, ema20 double, high20 double, swing double, previous double, clv double, vr double, weekly_score double, want string"
    rows = [(10.5, 10.0, 0.8, 1.0, 1.0, 9.5, 10.2, 9.0, 10.0, 0.9, 2.0, 0.3, "BREAKOUT"), (10.5, 10.0, 0.8, 1.0, 1.0, 10.4, 12.0, 9.5, 10.0, 0.9, 0.8, 0.3, "PULLBACK"), (10.5, 10.0, 0.8, 1.0, 1.0, 9.5, 10.2, 9.0, 10.0, 0.9, 2.0, 0.2, "NONE")]
    got = D.setup(spark.createDataFrame(rows, columns)).collect()
    assert [r["setup"] for r in got] == [r["want"] for r in got]
    assert got[0]["setup_score"] == pytest.approx(100 * (0.30 * (1 - 0.05 / 0.75) + 0.25 + 0.25 * 0.8 + 0.20 * 0.2), abs=1e-3)


def test_statuses(spark):
    rows = [(3.0, 4.5, 2.0, False, "strong", 1.38, 0.0, 10.9, "BULL"), (1.0, 1.0, 1.0, False, "medium", 0.6, 0.0, 3.6, "WEAK_BULL"), (0.5, 2.0, 0.4, False, "weak", 0.156, 0.0, 3.1, "WEAK_BULL"), (0.0, 5.0, -3.0, False, "", 0.0, -1.8, 0.2, "NEUTRAL"), (0.0, 5.0, -3.0, True, "", 0.0, -0.9, 1.1, "NEUTRAL"), (-5.0, -5.0, -5.0, False, "", 0.0, 0.0, -15.0, "EXTREME_BEAR"), (-3.0, 5.0, 0.0, False, "", 0.0, -0.81, 1.2, "NEUTRAL")]
    got = T.score_status(spark.createDataFrame(rows, "m double, w double, d double, discounted boolean, a string, b double, c double, t double, s string")).collect()
    for r in got:
        assert (r["strength"], r["status"], r["total"]) == (r["a"], r["s"], r["t"])
        assert r["bonus"] == pytest.approx(r["b"]) and r["penalty"] == pytest.approx(r["c"])


def _day(day, state, score, names):
    """names: code, group, weekly_trend, momentum."""
    return [(day, c, g, w, m, float(i), 0.0, 0.0, 0.0, state, score, 1e6, 1e6) for i, (c, g, w, m) in enumerate(names)]


def test_targets_by_regime(spark):
    rows = _day("d1", "NORMAL", 0.3, [("a", "g0", 0.3, 0.1), ("b", "g2", 0.3, 0.1)])  # one risk name: the fallback joins
    rows += _day("d2", "NORMAL", 0.3, [("a", "g0", 0.3, 0.1), ("b", "g1", 0.3, 0.1)])  # defensive names only: the fallback stands alone
    rows += _day("d3", "RISK_OFF", -0.6, [("a", "g0", 0.1, -0.1), ("b", "g2", -0.05, 0.1)])  # no recovery: trend floor 0, no fallback
    rows += _day("d4", "PULSE_FULL", 0.1, [("a", "g0", 0.3, 0.1), ("b", "g2", 0.3, 0.1), ("c", "g3", 0.3, -0.1), ("d", "g4", 0.3, 0.2)])  # no defensive name in a pulse, none that falls
    rows += _day("d5", "NORMAL", 0.3, [("a", "g0", 0.3, 0.1), ("b", "g1", 0.3, 0.1), ("c", "g2", 0.3, 0.1)])  # full with one risk name: the weakest defensive one goes
    columns = "date string, code string, industry_group string, weekly_trend double, momentum_20 double, relative_strength double, trend_efficiency_20 double, volume_confirmation double, priority double, market_state string, market_score double, amount double, broad_amount double"
    got = {}
    for r in G.select_targets(G.regime_scores(spark.createDataFrame(rows, columns)), ["g0", "g1"], 3).orderBy("date", "slot").collect():
        got.setdefault(r["date"], []).append(r["code"])
    assert got == {"d1": ["b", "a", "BROAD"], "d2": ["BROAD"], "d3": ["a"], "d4": ["d", "b"], "d5": ["c", "b", "BROAD"]}


def test_purged_holdout(spark):
    rows = spark.range(100).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7).cast("int")).alias("date"))
    got = {r["part"]: r["n"] for r in R.purged_holdout(rows).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"train": 70, "selection": 11, "approval": 11, None: 8}


def test_threshold_grid_equals_a_loop_and_keeps_empty_combinations(spark):
    from panelmill.operators import labels

    rows = [(0.1, 1.0, 5.0), (0.3, None, 7.0), (0.3, 2.0, 1.0), (-1.0, 9.0, 3.0)]
    steps = {"a": (0.0, 0.2, 0.9), "b": (1.0, 2.0)}
    got = {(r["t0"], r["t1"]): (r["kept"], r["s"]) for r in labels.threshold_grid(spark.createDataFrame(rows, "a double, b double, v double"), steps, {"s": F.col("v")}).collect()}
    want = {}
    for x in steps["a"]:
        for y in steps["b"]:
            met = [v for a, b, v in rows if a >= x and b is not None and b >= y]
            want[x, y] = (len(met), sum(met) if met else None)
    assert got == want and len(got) == 6
