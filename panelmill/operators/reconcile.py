"""Four sets that have to agree: what was planned, filled, reported as outcome and compared, by statement, code and side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.sources.cuts import stored

KEY = ["statement", "code", "side"]


#: Numbers of the statuses that a quantity can have, from 1; 0 is any other text.
STATUSES = ["UNFILLED", "FILLED", "PARTIALLY_FILLED"]
#: What a key keeps of its first outcome and of its first comparison.
OUTCOME = ["outcome_filled", "outcome_unfilled", "outcome_status"]
COMPARED = ["compared_planned", "compared_filled", "compared_unfilled", "compared_status"]


def _status(filled: str, unfilled: str) -> Column:
    return F.when(F.expr(filled) == 0, 1).when(F.expr(unfilled) == 0, 2).otherwise(3)


def _number(status: str) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), F.upper(status))


def _firsts(at_key: DataFrame, rows: DataFrame, count: str, kept: list[str]) -> DataFrame:
    """at_key, where keys with several rows keep what their row of the first position holds."""
    several, columns = at_key.where(F.col(count) > 1), at_key.columns
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in KEY])
    found = rows.alias("r").join(several.select(*KEY).alias("s").hint("shuffle_hash"), same("r", "s"), "left_semi")
    first = stored(found.groupBy(*KEY).agg(F.min(F.struct("position", *kept[:-1], "text", kept[-1])).alias("first")))
    mended = several.alias("s").join(first.alias("f").hint("shuffle_hash"), same("s", "f"))
    mended = mended.select(*[F.col(f"f.first.{c}").alias(c) if c in kept else F.col(f"s.{c}") for c in columns])
    return at_key.where(F.col(count) <= 1).unionByName(mended)


def merged(statements: DataFrame, planned: DataFrame, fills: DataFrame, outcomes: DataFrame, comparison: DataFrame) -> DataFrame:
    """One row per key that any set names, with sums, multiplicities and the first outcome and comparison.

    The sets are one tagged union and one shuffle; every aggregate is combined before it, so a key that holds a third of
    all fills is a few rows afterwards. All aggregates are numbers, so they are hashed: sorts are left to keys with several
    outcomes or comparisons, whose first one is looked up among their rows alone.
    """
    dated = fills.join(statements.select("statement", "execution_date").hint("shuffle_hash"), "statement", "left")
    fine = F.coalesce((F.col("shares") > 0) & (F.col("price") > 0) & (F.col("fee") >= 0) & (F.col("trade_date") == F.col("execution_date")), F.lit(False))
    shares = F.coalesce("shares", F.lit(0)).cast("long")
    as_kept = lambda names, *values: [F.col(v).alias(n) for n, v in zip(names, values, strict=False)]
    outcomes = outcomes.select(*KEY, "position", *as_kept(OUTCOME, "filled_shares", "unfilled_shares"), _number("status").alias(OUTCOME[-1]), F.col("status").alias("text"))
    comparison = comparison.select(*KEY, "position", *as_kept(COMPARED, "planned_shares", "shares", "unfilled_shares"), _number("fill_status").alias(COMPARED[-1]), F.col("fill_status").alias("text"))
    sets = [
        planned.select(*KEY, shares.alias("planned")),
        dated.select(*KEY, shares.alias("filled"), (~fine).cast("long").alias("bad_fills")),
        outcomes.select(*KEY, F.lit(1).alias("outcome"), *OUTCOME),
        comparison.select(*KEY, F.lit(1).alias("compared"), *COMPARED),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
    at_key = stored(
        rows.groupBy(*KEY).agg(
            *[F.sum(c).alias(c) for c in ("planned", "filled", "bad_fills")],
            *[F.count(c).alias(f"{c}s") for c in ("outcome", "compared")],
            *[F.min(c).alias(c) for c in (*OUTCOME, *COMPARED)],
        )
    )
    most = at_key.agg(F.max("outcomes").alias("outcomes"), F.max("compareds").alias("compareds")).first()
    for count, own, kept in (("outcomes", outcomes, OUTCOME), ("compareds", comparison, COMPARED)):
        if (most[count] or 0) > 1:
            at_key = _firsts(at_key, own, count, kept)
    return at_key


def findings(statements: DataFrame, planned: DataFrame, fills: DataFrame, outcomes: DataFrame, comparison: DataFrame) -> DataFrame:
    """One row per broken rule: statement, code, side, finding (code and side are null for a statement's completion).

    statements: statement, execution_date, completion; planned: key, shares; fills: key, shares, price, fee, trade_date;
    outcomes: key, position, filled_shares, unfilled_shares, status; comparison: key, position, planned_shares, shares,
    unfilled_shares, fill_status. Of several outcomes of one key the first position counts, the others are duplicates.
    A missing number breaks the rule that reads it; null shares are 0; null keys form a key of their own; statements
    without plans and outcomes are UNFILLED; empty sets give what their absence breaks.
    """
    at_key = merged(statements, planned, fills, outcomes, comparison)
    filled, wanted = F.coalesce("filled", F.lit(0)), F.coalesce("planned", F.lit(0))
    out, com = {c: F.col(f"outcome_{c}") for c in ("filled", "unfilled", "status")}, {c: F.col(f"compared_{c}") for c in ("planned", "filled", "unfilled", "status")}
    status = _status("outcome_filled", "outcome_unfilled")
    outcome_ok = (out["filled"] >= 0) & (out["unfilled"] >= 0) & (out["filled"] + out["unfilled"] == wanted) & (filled == out["filled"]) & (out["status"] == status)
    compared_ok = (com["filled"] == out["filled"]) & (com["unfilled"] == out["unfilled"]) & (com["planned"] == F.col("planned")) & (com["status"] == status)
    at_key = at_key.withColumns({"outcome_ok": F.coalesce(outcome_ok, F.lit(False)), "compared_ok": F.coalesce(compared_ok, F.lit(False))})
    rules = [
        ("FILL_INVALID", "bad_fills > 0"),
        ("FILL_WITHOUT_PLAN", "filled IS NOT NULL AND planned IS NULL"),
        ("OUTCOME_WITHOUT_PLAN", "outcomes > 0 AND planned IS NULL"),
        ("OUTCOME_MISSING", "outcomes = 0 AND planned IS NOT NULL"),
        ("OUTCOME_DUPLICATE", "outcomes > 1"),
        ("OUTCOME_INVALID", "outcomes > 0 AND NOT outcome_ok"),
        ("COMPARISON_WITHOUT_PLAN", "compareds > 0 AND planned IS NULL"),
        ("COMPARISON_MISSING", "compareds = 0 AND planned IS NOT NULL"),
        ("COMPARISON_DUPLICATE", "compareds > 1"),
        ("COMPARISON_INVALID", "compareds > 0 AND NOT compared_ok"),
    ]
    broken = F.array(*[F.when(F.expr(rule), name) for name, rule in rules])
    by_key = at_key.select(*KEY, F.explode(broken).alias("finding")).where("finding IS NOT NULL")
    totals = at_key.groupBy("statement").agg(F.sum(F.greatest("planned", F.lit(0))).alias("planned"), F.sum(F.greatest(out["filled"], F.lit(0))).alias("filled"))
    completion = F.when(F.coalesce("filled", F.lit(0)) == 0, "UNFILLED").when(F.col("filled") == F.col("planned"), "COMPLETE").otherwise("PARTIAL")
    wrong = statements.join(totals.hint("shuffle_hash"), "statement", "left").where(~F.coalesce(F.col("completion") == completion, F.lit(False)))
    types = {f.name: f.dataType for f in planned.schema}
    return by_key.unionByName(wrong.select("statement", *[F.lit(None).cast(types[c]).alias(c) for c in ("code", "side")], F.lit("COMPLETION_MISMATCH").alias("finding")))
