"""Each finding of the four sets on literal statements."""

import datetime

from panelmill.operators import reconcile as R
from panelmill.plans import registry

DAY = datetime.date(2024, 1, 10)
SCHEMAS = [
    "statement long, execution_date date, completion string",
    "statement long, code string, side string, shares long",
    "statement long, code string, side string, shares long, price double, fee double, trade_date date",
    "statement long, code string, side string, position int, filled_shares long, unfilled_shares long, status string",
    "statement long, code string, side string, position int, planned_shares long, shares long, unfilled_shares long, fill_status string",
]
PLAN, FILL = ("A", "BUY", 100), ("A", "BUY", 100, 2.0, 0.0, DAY)
OUT, COMPARED = ("A", "BUY", 0, 100, 0, "filled"), ("A", "BUY", 0, 100, 100, 0, "FILLED")
WHOLE = ["COMPLETE", [PLAN], [FILL], [OUT], [COMPARED]]
#: What changes against the whole statement, and what is then found.
CASES = [
    ({}, []),
    ({2: [("A", "BUY", 60, 2.0, 0.0, DAY), ("A", "BUY", 40, 2.0, 0.0, DAY)]}, []),
    ({2: [("A", "BUY", 100, 0.0, 0.0, DAY)]}, ["FILL_INVALID"]),
    ({2: [("A", "BUY", 100, 2.0, None, DAY)]}, ["FILL_INVALID"]),
    ({2: [("A", "BUY", 100, 2.0, 0.0, DAY + datetime.timedelta(days=1))]}, ["FILL_INVALID"]),
    ({2: [FILL, ("B", "BUY", 5, 2.0, 0.0, DAY)]}, ["FILL_WITHOUT_PLAN"]),
    ({2: [FILL, ("A", "SELL", 5, 2.0, 0.0, DAY)]}, ["FILL_WITHOUT_PLAN"]),
    ({2: [FILL, FILL]}, ["OUTCOME_INVALID"]),
    ({3: [OUT, ("A", "BUY", 1, 100, 0, "FILLED")]}, ["OUTCOME_DUPLICATE"]),
    ({3: []}, ["COMPARISON_INVALID", "COMPLETION_MISMATCH", "OUTCOME_MISSING"]),
    ({3: [("A", "BUY", 0, 100, 0, "UNFILLED")]}, ["OUTCOME_INVALID"]),
    ({3: [OUT, ("B", "BUY", 1, 0, 0, "UNFILLED")]}, ["OUTCOME_WITHOUT_PLAN"]),
    ({4: []}, ["COMPARISON_MISSING"]),
    ({4: [COMPARED, COMPARED]}, ["COMPARISON_DUPLICATE"]),
    ({4: [("A", "BUY", 0, 90, 100, 0, "FILLED")]}, ["COMPARISON_INVALID"]),
    ({0: "PARTIAL"}, ["COMPLETION_MISMATCH"]),
    ({0: "PARTIAL", 2: [("A", "BUY", 60, 2.0, 0.0, DAY)], 3: [("A", "BUY", 0, 60, 40, "PARTIALLY_FILLED")], 4: [("A", "BUY", 0, 100, 60, 40, "PARTIALLY_FILLED")]}, []),
    ({0: "UNFILLED", 2: [], 3: [("A", "BUY", 0, 0, 100, "UNFILLED")], 4: [("A", "BUY", 0, 100, 0, 100, "UNFILLED")]}, []),
    ({0: "UNFILLED", 1: [], 2: [], 3: [], 4: []}, []),
]


def test_findings(spark):
    rows = [[] for _ in SCHEMAS]
    for n, (changes, _) in enumerate(CASES):
        own = [changes.get(i, part) for i, part in enumerate(WHOLE)]
        rows[0].append((n, DAY, own[0]))
        for i in range(1, 5):
            rows[i] += [(n, *r) for r in own[i]]
    sets = [spark.createDataFrame(r, s) for r, s in zip(rows, SCHEMAS, strict=True)]
    got = {}
    for r in R.findings(*sets).collect():
        got.setdefault(r["statement"], []).append(r["finding"])
    assert {n: sorted(got.get(n, [])) for n in range(len(CASES))} == {n: want for n, (_, want) in enumerate(CASES)}
    assert R.findings(*[s.limit(0) for s in sets]).count() == 0


def _found(spark, planned, fills, outcomes, comparison, completion="COMPLETE"):
    rows = [[(1, DAY, completion)], *[[(1, *r) for r in part] for part in (planned, fills, outcomes, comparison)]]
    return sorted((r["code"], r["finding"]) for r in R.findings(*[spark.createDataFrame(r, s) for r, s in zip(rows, SCHEMAS, strict=True)]).collect())


def test_of_several_rows_the_first_position_counts_whole(spark):
    """Its numbers are taken together, though later rows hold smaller and larger ones; a null side is a key of its own."""
    outs = [(None, None, 2, 30, 0, "UNFILLED"), (None, None, 1, 100, 0, "filled"), (None, None, 3, 0, 100, "UNFILLED")]
    made = [(None, None, 4, 1, 1, 1, None), (None, None, 0, 100, 100, 0, "FILLED")]
    plan, fill = (None, None, 100), (None, None, 100, 2.0, 0.0, DAY)
    assert _found(spark, [plan], [fill], outs, made) == [(None, "COMPARISON_DUPLICATE"), (None, "OUTCOME_DUPLICATE")]
    wrong = [(None, None, 0, *outs[0][3:]), *outs[1:]]
    assert _found(spark, [plan], [fill], wrong, made[1:], "PARTIAL") == [(None, "COMPARISON_INVALID"), (None, "OUTCOME_DUPLICATE"), (None, "OUTCOME_INVALID")]


def test_line_items_are_read_for_the_lines_alone_and_keys_are_hashed(spark):
    """No task sorts the rows of the sets or holds all orders, and the findings start from the keys as merged once."""
    plan = registry.queries()["four_set_findings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "l_orderkey" not in plan.optimizedPlan().toString()
    assert not any(step in plan.sparkPlan().toString() for step in ("SortAggregate", "SortMergeJoin", "BroadcastHashJoin"))
