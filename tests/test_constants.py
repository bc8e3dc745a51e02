"""Single operators with known values, and invariances."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions import costs
from panelmill.functions import expressions as X
from panelmill.operators import calendar as C
from panelmill.operators import crosssection as S
from panelmill.operators import labels as L
from panelmill.operators import policy as P
from panelmill.sources import bars as B


def test_benjamini_hochberg(spark):
    rows = S.benjamini_hochberg(spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.20)], "factor string, p double")).collect()
    assert {r["factor"]: round(r["q"], 12) for r in rows} == {"a": 0.003, "b": 0.03, "c": 0.20}


def test_cost_model(spark):
    e = spark.range(1).select(costs.estimate(F.lit("BUY"), F.lit(10.0), F.lit(20000.0), F.lit(1e6)).alias("e"), costs.capacity_lot(F.lit(10.0), F.lit(1e7)).alias("lots")).first()
    assert e["e"]["capacity_exceeded"] and e["e"]["participation"] == pytest.approx(0.10) and e["lots"] == 100_000
    assert e["e"]["total_cost"] == pytest.approx(200000 * (0.00019 + (5 + 18 * 0.1**0.5) / 1e4))
    zero = spark.range(1).select(costs.estimate(F.lit("SELL"), F.lit(0.0), F.lit(5.0), F.lit(None).cast("double")).alias("e")).first()["e"]
    assert zero["total_cost"] == 0.0 and zero["effective_price"] == 0.0


LADDER = [(-0.6, 50, "NONE", "RISK_OFF"), (0.4, 98, "NONE", "DEFENSIVE"), (0.1, 98, "NONE", "HARD_DEFENSIVE"), (0.3, 96, "NONE", "CAUTIOUS"), (0.1, 96, "NONE", "DEFENSIVE"), (-0.3, 10, "NONE", "HARD_DEFENSIVE"), (-0.1, 10, "NONE", "DEFENSIVE"), (0.1, 10, "NONE", "CAUTIOUS"), (0.2, 10, "NONE", "NORMAL"), (-0.1, 99, "NONE", "RISK_OFF"), (0.04, 99, "FULL", "PULSE_CAUTIOUS"), (0.05, 99, "FULL", "PULSE_FULL"), (-0.1, 50, "EARLY", "PULSE_EARLY"), (-0.1, 50, "MILD", "PULSE_CAUTIOUS"), (0.3, 50, "MILD", "PULSE_FULL")]


def test_exposure_ladder(spark):
    rows = P.exposure_ladder(spark.createDataFrame([(float(a), float(b), c, d) for a, b, c, d in LADDER], "score double, stress double, pulse string, want string")).collect()
    assert [r["state"] for r in rows] == [r["want"] for r in rows]


PULSES = [(0, 0, 0.06, 0, 95, 0.3, "FULL"), (0, 0, 0.06, 0, 50, 0.3, "NONE"), (0, 0, 0.06, 0, 50, 0.05, "FULL"), (0, 0.026, 0, 0, 92, 0.3, "MILD"), (0.01, 0.013, 0, 0, 50, -0.2, "EARLY"), (0.0, 0.013, 0, 0, 50, -0.2, "NONE"), (0.0, 0.013, 0, 0, 60, -0.2, "EARLY"), (0, 0.005, 0.016, 0, 60, -0.5, "NONE"), (0, 0.013, 0, -0.06, 60, -0.2, "NONE")]


def test_policy_pulse(spark):
    cols = "ret_1 double, ret_3 double, ret_5 double, ret_10 double, stress double, raw_score double, want string"
    rows = P.policy_pulse(spark.createDataFrame([(*map(float, r[:6]), r[6]) for r in PULSES], cols)).collect()
    assert [r["pulse"] for r in rows] == [r["want"] for r in rows]


def test_weekday_arithmetic(spark):
    pairs = [(date(2026, 7, 10), date(2026, 7, 13)), (date(2026, 7, 13), date(2026, 7, 13)), (date(2026, 7, 11), date(2026, 7, 19)), (date(2026, 7, 20), date(2026, 7, 13)), (None, date(2026, 7, 13))]
    rows = spark.createDataFrame(pairs, "a date, b date").select(C.weekdays_between(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in rows] == [1, 0, 5, 0, 999]


def test_expressions(spark):
    tree = X.parse("div(sub(a, b), neg(c))")
    assert X.text(tree) == "div(sub(a, b), neg(c))" and X.nodes(tree) == 6 and X.depth(tree) == 3 and not X.problems(tree, {"a", "b", "c"})
    assert X.problems(X.parse("add(a)"), {"a"}) and X.problems(X.parse("nope(a)"), {"a"}) and X.problems(X.parse("z"), {"a"})
    for wrong in ("a.b", "__import__('os')", "a + b", "add(a, b=c)", "(", "1"):
        with pytest.raises(ValueError):
            X.parse(wrong)
    got = spark.createDataFrame([(3.0, 1.0, 0.1), (3.0, 1.0, -0.1), (30.0, 1.0, 0.0), (None, 1.0, 1.0)], "a double, b double, c double").select(X.column(tree).alias("v")).collect()
    assert [r["v"] for r in got] == [-8.0, 8.0, 20.0, 0.0]


def test_neutral_scores_have_no_group_mean(spark):
    rng = np.random.default_rng(1)
    rows = [(date(2024, 1, 1 + d), f"c{i}", f"g{i % 3}", float(x)) for d in range(5) for i, x in enumerate(rng.normal(size=9))]
    out = S.neutralised(spark.createDataFrame(rows, "date date, code string, industry_group string, v double"), "v")
    means = out.groupBy("date", "industry_group").agg(F.avg("neutral").alias("m")).collect()
    assert max(abs(r["m"]) for r in means) < 1e-9


def test_folds_never_overlap():
    folds = L.walk_forward_folds(date(2015, 1, 1), date(2020, 1, 1))
    assert len(folds) >= 5
    for (_, _, train_end, start, end), after in zip(folds, folds[1:], strict=False):
        assert train_end < start < end <= after[3]


def test_logistic_fit_has_zero_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [1, -2, 0.5] + rng.normal(size=400) > 0).astype(float)
    w = L.fit_logistic(x, y)
    full = np.column_stack([np.ones(400), x])
    p = 1 / (1 + np.exp(-full @ w))
    assert np.abs(full.T @ (y - p) - np.r_[0, 1, 1, 1] * w).max() < 1e-5


def test_aliases(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "vol long, volume long, px double")
    out = B.aliased(df, {"volume": ["volume", "vol"], "close": ["close", "px"], "open": ["open"]})
    assert out.columns == ["volume", "close"] and tuple(out.first()) == (1, 2.0)


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", date(2024, 1, 5)), ("a", date(2024, 1, 1)), ("b", date(2024, 1, 5))], "code string, date date")
    right = spark.createDataFrame([("a", date(2024, 1, 2), 1.0), ("a", date(2024, 1, 5), 2.0), ("a", date(2024, 1, 6), 3.0)], "code string, date date, v double")
    assert sorted(map(tuple, C.as_of(left, right, "v").collect())) == [("a", date(2024, 1, 1), None), ("a", date(2024, 1, 5), 2.0), ("b", date(2024, 1, 5), None)]
