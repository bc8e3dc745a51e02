"""Held names, the choice of a buffer, path metrics, gates and the broad-market guard on literal cases."""

from datetime import date, timedelta

import pytest

from panelmill.operators import holdings as H
from panelmill.operators import regime as G

D = [date(2024, 1, 1) + timedelta(days=7 * k) for k in range(60)]


def ranked(spark, lists):
    rows = [(d, k + 1, code) for d, names in zip(D, lists, strict=False) for k, code in enumerate(names)]
    return spark.createDataFrame(rows, "date date, rank int, code string")


def names(df, **where):
    out = {}
    for r in df.collect():
        if all(r[k] == v for k, v in where.items()):
            out.setdefault(r["date"], {})[r["slot"]] = (r["code"], r["incumbent"])
    return [[out[d][s] for s in sorted(out[d])] for d in sorted(out)]


def test_a_name_stays_as_long_as_it_ranks_within_the_buffer(spark):
    got = H.held(ranked(spark, ["ABCD", "CDAB", "CDEA", "DCEF"]), 2, (0, 2))
    assert names(got, buffer=2) == [[("A", False), ("B", False)], [("A", True), ("B", True)], [("A", True), ("C", False)], [("C", True), ("D", False)]]
    assert names(got, buffer=0) == [[("A", False), ("B", False)], [("C", False), ("D", False)], [("C", True), ("D", True)], [("C", True), ("D", True)]]


def test_incumbents_of_the_buffer_case(spark):
    # Four names in four groups; A and C are held. With one name of buffer both stay; A and D held gives A and B.
    assert H.next_holding(["A", "C"], ["A", "B", "C"], 2) == (["A", "C"], 2)
    assert H.next_holding(["A", "D"], ["A", "B", "C"], 2) == (["A", "B"], 1)


def test_sleeves_keep_names_of_their_own(spark):
    got = H.held(ranked(spark, ["AB", "BA", "CA", "AC"]), 1, (1,), sleeves=2)
    assert names(got, sleeve=0) == [[("A", False)], [("A", True)]] and names(got, sleeve=1) == [[("B", False)], [("A", False)]]
    assert H.held(ranked(spark, []), 1, (1,)).count() == 0


def test_a_date_without_names_empties_the_sleeve(spark):
    rows = spark.createDataFrame([(D[0], 1, "A"), (D[1], 1, None), (D[2], 1, "B"), (D[2], 2, "A")], "date date, rank int, code string")
    assert names(H.held(rows, 1, (1,))) == [[("A", False)], [("B", False)]]


def test_choice_of_a_buffer(spark):
    kind = "buffer int, information_ratio double, excess_return double, max_drawdown double, turnover double"
    pick = lambda rows: [(r["buffer"], r["eligible"]) for r in H.choose_buffer(spark.createDataFrame(rows, kind)).where("selected").collect()]
    assert pick([(0, 0.9, 0.5, 0.30, 1.0), (1, 0.5, 0.4, 0.20, 1.0), (2, 0.5, 0.6, 0.25, 1.0)]) == [(2, True)]
    assert pick([(0, 0.5, 0.5, 0.1, 3.0), (1, 0.5, 0.5, 0.1, 2.0), (2, 0.5, 0.5, 0.1, 2.0)]) == [(1, True)]
    assert pick([(0, -0.5, -0.5, 0.1, 3.0), (1, -0.2, -0.5, 0.1, 2.0), (2, None, None, None, None)]) == [(1, False)]


def test_path_metrics_equal_a_loop(spark):
    r = [0.02, -0.05, 0.01, 0.03] * 15
    rb = [0.01, -0.01, 0.0, 0.01] * 15
    got = H.path_metrics(spark.createDataFrame([("x", d, a, b) for d, a, b in zip(D, r, rb, strict=True)], "code string, date date, r double, rb double")).first()
    rel, path, best, run, longest, fall = 1.0, [], 1.0, 0, 0, 0.0
    for a, b in zip(r, rb, strict=True):
        rel *= (1 + a) / (1 + b)
        best = max(best, rel)
        run = run + 1 if round(rel, 9) < round(best, 9) else 0
        longest, fall = max(longest, run), max(fall, 1 - rel / best)
        path.append(rel)
    excess = []
    for k in range(52, 61):
        own = market = 1.0
        for a, b in zip(r[k - 52 : k], rb[k - 52 : k], strict=True):
            own, market = own * (1 + a), market * (1 + b)
        excess.append(own - market)
    assert (got["rolling"], got["under_water"], got["years"]) == (9, longest, 2)
    assert got["relative_drawdown"] == pytest.approx(fall, abs=1e-6) and got["rolling_worst"] == pytest.approx(min(excess), abs=1e-6)
    assert got["rolling_positive"] == pytest.approx(sum(e > 0 for e in excess) / 9, abs=1e-6)


#: A path that meets every gate exactly at its bound or just inside.
GOOD = {"excess_return": 0.01, "information_ratio": 0.2501, "max_drawdown": 0.25, "benchmark_drawdown": 0.25, "years": 5, "positive_years": 0.6, "rolling": 104, "rolling_positive": 0.6, "rolling_worst": -0.25, "relative_drawdown": 0.30, "under_water": 260, "capacity_fill": 0.9}
GOOD |= {"recent_excess_return": 0.01, "recent_information_ratio": 0.2501, "recent_max_drawdown": 0.25, "recent_years": 2, "recent_positive_years": 0.5, "recent_rolling": 26, "recent_rolling_positive": 0.6, "recent_rolling_worst": -0.2, "recent_relative_drawdown": 0.25, "recent_under_water": 104, "recent_capacity_fill": 0.9}
BAD = {"excess_return": (0.0, 0), "information_ratio": (0.25, 1), "benchmark_drawdown": (0.24, 2), "positive_years": (0.59, 4), "years": (4, 4), "rolling": (103, 5), "rolling_positive": (0.59, 6), "rolling_worst": (-0.2501, 7), "relative_drawdown": (0.3001, 8), "under_water": (261, 9)}
BAD |= {"recent_excess_return": (0.0, 10), "recent_information_ratio": (0.25, 11), "recent_max_drawdown": (0.2501, 12), "recent_positive_years": (0.49, 13), "recent_years": (1, 13), "recent_rolling": (25, 14), "recent_rolling_positive": (0.59, 15), "recent_rolling_worst": (-0.2001, 16), "recent_relative_drawdown": (0.2501, 17), "recent_under_water": (105, 18), "capacity_fill": (0.89, 19), "recent_capacity_fill": (0.89, 20)}


def test_every_gate_at_its_bound(spark):
    rows = [("good", GOOD)] + [(k, GOOD | {k: v}) for k, (v, _) in BAD.items()] + [("null", dict.fromkeys(GOOD))]
    kind = "which string, " + ", ".join(f"{k} double" for k in GOOD)
    df = spark.createDataFrame([(w, *[None if r[k] is None else float(r[k]) for k in GOOD]) for w, r in rows], kind)
    got = {r["which"]: (r["failed"], r["approved"]) for r in H.rotation_gates(df).collect()}
    assert len(H.GATES) == 21 and got["good"] == ("", True)
    assert got["null"] == (",".join(n for n, _ in H.GATES), False)
    for k, (_, gate) in BAD.items():
        assert got[k] == (H.GATES[gate][0], False), k
    # A deeper fall breaks the bound and the comparison with the benchmark.
    deep = H.rotation_gates(df.where("which = 'good'").selectExpr("* EXCEPT (max_drawdown)", "0.26D AS max_drawdown")).first()["failed"]
    assert deep == f"{H.GATES[2][0]},{H.GATES[3][0]}"


def test_the_broad_market_is_not_added_beside_a_name_of_its_group(spark):
    rows = [(D[0], "X", "broad_market"), (D[1], "Y", "growth")]
    kind = "date date, code string, industry_group string, rotation_score double, weekly_trend double, momentum_20 double, amount double, broad_amount double, recovery boolean, market_state string"
    df = spark.createDataFrame([(*r, 0.9, 0.5, 0.1, 9.0, 9.0, True, "NORMAL") for r in rows], kind)
    got = sorted((r["date"], r["slot"], r["code"]) for r in G.select_targets(df, ["gold"], 3).collect())
    assert got == [(D[0], 1, "X"), (D[1], 1, "Y"), (D[1], 2, G.FALLBACK_CODE)]
