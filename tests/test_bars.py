from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelmill.operators import search as H
from panelmill.plans import panel_plan as P
from panelmill.plans import registry
from panelmill.sources import bars as B

SF = "/root/testdata/sf0.001"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"


@pytest.fixture()
def tables(spark, tmp_path):
    """Trades with equal leading keys, equal line numbers, copies, nulls in every key, and a part that is named twice."""
    days = [datetime(2001, 1, 1), datetime(2001, 1, 2), None]
    rows = [(k if k else None, p, s, n, float(q), 10.0 * q + p + s + n, days[(k + p) % 3]) for k in range(4) for p in range(5) for s in range(2) for n in (1, 2) for q in (1, 2)]
    rows += rows[::7] + [(7, None, 1, 1, 1.0, 5.0, days[0]), (None, 3, None, None, None, None, days[1]), (9, 1, 1, 1, None, 4.0, days[0])]
    parts = [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, None), (4, "c")]
    spark.createDataFrame(rows, LINES).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("few", [B.FEW_CODES, 0])
def test_open_and_close_follow_the_whole_order(spark, tables, monkeypatch, few):
    monkeypatch.setattr(B, "FEW_CODES", few)
    got = B.daily_bars(spark, tables)
    want = B.trades(spark, tables).groupBy("code", "date").agg(
        F.min_by("price", "sequence").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "sequence").alias("close"),
        F.sum("quantity").alias("volume"), F.round(F.sum("amount"), 6).alias("amount"), F.count(F.lit(1)).alias("trades"),
    )
    assert got.columns == want.columns and got.count() > 9
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_trades_are_hashed_not_sorted(spark):
    """Only the trades at the ends of a session's leading key are sorted: a task's memory doesn't grow with the trades it reads."""
    plan = B.daily_bars(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    first = plan.index("BroadcastHashJoin")  # the ends and their totals lie behind it, and the sorted aggregate before it
    assert "SortAggregate" in plan[:first] and "SortAggregate" not in plan[first:] and plan[first:].count("HashAggregate") == 2


def test_the_stop_sorts_no_trades(spark):
    plan = registry.queries()["chandelier_stop"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan[plan.index("BroadcastHashJoin"):]


def test_many_parts_are_dealt_not_sent_to_every_task(spark, tables, monkeypatch):
    """What a task holds of the parts doesn't grow with their number, and no trades are sorted for it."""
    few = sorted(map(tuple, B.daily_bars(spark, tables).collect()), key=repr)
    monkeypatch.setattr(B, "FEW_PARTS", 2)
    many = B.daily_bars(spark, tables)
    plan = many._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    assert sorted(map(tuple, many.collect()), key=repr) == few


def _reads_trades(rows):
    return "l_extendedprice" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_factor_search_reads_the_panel_not_the_trades(spark, monkeypatch):
    """Every generation reads its rows several times."""
    given = []
    monkeypatch.setattr(H, "evolve", lambda rows, features: given.append(rows) or [{"expression": "x", "generation": 0, "fitness": 0.0, "ic_mean": 0.0, "turnover": 0.0}])
    registry.queries()["genetic_factors"](spark, SF)
    monkeypatch.setattr(H, "complementary_sets", lambda rows, features: given.append(rows) or [{"set": "x", "weights": [1.0], "ic_mean": 0.0, "gain": 0.0, "score": 0.0, "reasons": [""]}])
    registry.queries()["complementary_factors"](spark, SF)
    assert len(given) == 2 and not any(_reads_trades(rows) for rows in given) and given[0].count() > 0


def test_signal_states_read_the_trades_for_the_bars_alone(spark):
    """Its dozen inputs all start from the bars."""
    assert not _reads_trades(registry.queries()["signal_states"](spark, SF))


def test_the_calibration_panel_reads_the_trades_for_the_bars_alone(spark):
    assert not _reads_trades(P.panel(spark, SF))
