"""Factor search on a small panel whose answer is known, and scores and caps against plain arithmetic."""

import random

import pytest

from panelmill.functions import expressions as X
from panelmill.operators import scores, search


@pytest.fixture(scope="module")
def rows(spark):
    """40 dates of 12 codes; forward is a + b - 2c and some noise, d is noise."""
    rng, out = random.Random(5), []
    for t in range(40):
        for k in range(12):
            a, b, c, d = (rng.gauss(0, 1) for _ in range(4))
            out.append((f"2020-{1 + t // 28:02d}-{1 + t % 28:02d}", f"x{k:02d}", a, b, c, d, a + b - 2 * c + rng.gauss(0, 0.5)))
    return spark.createDataFrame(out, "date string, code string, a double, b double, c double, d double, forward double").cache()


def test_evolution_finds_the_factors_and_repeats_itself(rows):
    found = search.evolve(rows, ["a", "b", "c", "d"], population=10, generations=2, seed=1)
    again = search.evolve(rows, ["a", "b", "c", "d"], population=10, generations=2, seed=1)
    assert [(r["expression"], r["fitness"]) for r in found] == [(r["expression"], r["fitness"]) for r in again]
    assert all(r["ic_mean"] >= 0 and not X.problems(r["tree"], set("abcd")) for r in found)
    assert [r["fitness"] for r in found] == sorted((r["fitness"] for r in found), reverse=True)
    alone = {r["expression"]: r["ic_mean"] for r in found}
    assert alone["neg(c)"] > alone["a"] > 0.2 and found[0]["ic_mean"] >= alone["neg(c)"]


def test_a_negated_column_has_the_negative_mean(rows):
    from pyspark.sql import functions as F

    plain, negated = ({r["factor"]: r["ic_mean"] for r in search.evaluate(rows, {"x": c})}["x"] for c in (F.col("c"), -F.col("c")))
    assert plain == pytest.approx(-negated) and plain < 0


def test_complementary_sets(rows):
    found = {r["set"]: r for r in search.complementary_sets(rows, ["a", "b", "d"])}
    assert set(found) == {"a+b", "a+d", "b+d", "a+b+d"}
    assert found["a+b"]["reasons"] == [] and found["a+b"]["gain"] > 0.05
    assert all(abs(sum(r["weights"]) - 1) < 1e-5 and min(r["weights"]) >= 0 for r in found.values())
    assert search.complementary_sets(rows.where("false"), ["a", "b"]) == []


def test_diverse():
    assert search.diverse(["p", "q", "r", "s"], {("p", "q"), ("q", "r"), ("s", "r")}) == ["p", "r"]


def test_caps_of_known_paths(spark):
    def cap(path):
        days = [(f"2020-01-{i + 1:02d}", "x", float(v), 100.0) for i, v in enumerate(path)]
        return scores.exposure_caps(spark.createDataFrame(days, "date string, code string, s double, b double")).orderBy("date").collect()[-1]["cap"]

    assert [cap(p) for p in ([100, 91], [100, 87], [100, 79], [100], [100, 99])] == [0.82, 0.68, 0.38, 1.0, 1.0]


def test_environment_of_a_rising_market(spark):
    row = (130, 110.0, 108.0, 105.0, 100.0, 95.0, 0.5, 0.4, 0.3, 0.2, 1.6, 1.0, 50.0)
    schema = "bars int, close double, previous double, ma20 double, ma60 double, ma120 double, h0 double, h1 double, h2 double, h3 double, vr double, atr_pct double, pctl double"
    got = scores.environment(spark.createDataFrame([row, (60, *row[1:]), (130, *[None] * 12)], schema)).collect()
    assert (got[0]["trend"], got[0]["momentum"], got[0]["volume"], got[0]["volatility"], got[0]["total"], got[0]["status"]) == (4.0, 2.0, 2.0, 0.0, 6.8, "STRONG_BULL")
    assert (got[1]["total"], got[1]["status"], got[1]["risk_level"], got[1]["atr_multiplier"]) == (-6.0, "STRONG_BEAR", "HIGH", 1.2)
    assert got[2]["trend"] == 0.0


def test_fewer_names_carry_larger_shares(spark):
    rows = [("d", "p", "g1", 0.9, 60.0), ("d", "q", "g2", 0.8, 40.0), ("d", "r", "g3", 0.7, 160.0), ("e", "p", "g1", 0.9, 10.0), ("f", "p", "g1", 0.9, 200.0), ("f", "q", "g1", 0.8, 200.0)]
    scored = spark.createDataFrame(rows, "date string, code string, industry_group string, rotation_score double, adv double")
    got = sorted((r["date"], r["code"], r["names"]) for r in scores.capacity_targets(scored, 15.0, 3, 0.1).collect())
    assert got == [("d", "r", 1), ("f", "p", 1)]
