"""The plan ledger: rules on small histories, the stream against the batch operator."""

import datetime
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelmill.operators import ledger as G
from panelmill.plans.ledger_plan import plan_events
from panelmill.streaming import events as T
from panelmill.streaming import ledger as S

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 10)
SCHEMA = "authority long, day date, plan_id long, event_id long, ts timestamp, kind string"


def history(*steps):
    """(plan, days after DAY, kind) in order, ids rising."""
    return [(1, DAY, plan, n, datetime.datetime(2024, 1, 10, 9, n) + datetime.timedelta(days=days), kind) for n, (plan, days, kind) in enumerate(steps)]


CASES = [
    ("open", history((7, 0, "EXPECTED")), 1, {7: ("EXPECTED", None, 1)}),
    ("missed", history((7, 0, "EXPECTED")), 2, {7: ("MISSED", None, 1)}),
    ("observed", history((7, -1, "EXPECTED"), (7, 0, "ESTIMATE")), 7, {7: ("OBSERVED", "PENDING", 2)}),
    ("overdue", history((7, -1, "EXPECTED"), (7, 0, "ESTIMATE")), 8, {7: ("OBSERVED", "OVERDUE", 2)}),
    ("confirmed", history((7, -1, "EXPECTED"), (7, 0, "ESTIMATE"), (7, 1, "CONFIRMED")), 30, {7: ("OBSERVED", "CONFIRMED", 3)}),
    ("booked again", history((7, 0, "ESTIMATE"), (7, 0, "CONFIRMED"), (7, 1, "ESTIMATE")), 3, {7: (None, "PENDING", 3)}),
    ("feedback first", history((7, -1, "CONFIRMED"), (7, 0, "EXPECTED")), 1, {7: ("EXPECTED", "CONFIRMED", 2)}),
    ("superseded", history((7, -1, "EXPECTED"), (8, 0, "EXPECTED")), 1, {7: ("SUPERSEDED", None, 1), 8: ("EXPECTED", None, 1)}),
    ("too late to supersede", history((7, 0, "EXPECTED"), (8, 1, "EXPECTED")), 1, {7: ("EXPECTED", None, 1), 8: ("EXPECTED", None, 1)}),
    ("observed stays", history((7, -1, "EXPECTED"), (7, -1, "NO_ORDERS"), (8, 0, "EXPECTED")), 1, {7: ("OBSERVED", None, 2), 8: ("EXPECTED", None, 1)}),
    ("superseded is not opened again", history((7, -1, "EXPECTED"), (8, -1, "EXPECTED"), (7, 0, "EXPECTED")), 1, {7: ("SUPERSEDED", None, 2), 8: ("EXPECTED", None, 1)}),
    ("feedback after", history((7, -1, "EXPECTED"), (8, -1, "EXPECTED"), (7, 0, "CONFIRMED")), 1, {7: ("SUPERSEDED", "CONFIRMED", 2), 8: ("EXPECTED", None, 1)}),
    ("rejected changes nothing", history((7, 0, "EXPECTED"), (7, 0, "REJECTED"), (7, 0, None)), 1, {7: ("EXPECTED", None, 3)}),
    ("repeated id", history((7, 0, "ESTIMATE"), (7, 0, "CONFIRMED")) + [(1, DAY, 7, 0, datetime.datetime(2024, 1, 12), "ESTIMATE")], 9, {7: (None, "CONFIRMED", 2)}),
    ("nulls", [(None, DAY, 7, 1, datetime.datetime(2024, 1, 10), "EXPECTED"), (1, None, 7, 2, datetime.datetime(2024, 1, 10), "EXPECTED"), (1, DAY, 7, 3, None, "EXPECTED")], 1, {}),
]


def test_rules(spark):
    """All cases at once, each an authority of its own."""
    rows, want = [], {}
    for n, (_, events, behind, states) in enumerate(CASES):
        rows += [(behind, a if a is None else n, day, p, e if e is None else n * 100 + e, ts, kind) for a, day, p, e, ts, kind in events]
        want.update({(n, p): s for p, s in states.items()})
    events = spark.createDataFrame(rows, "behind int, " + SCHEMA)
    got = {}
    for behind in {c[2] for c in CASES}:
        states = G.plan_states(events.where(F.col("behind") == behind), F.lit(DAY + datetime.timedelta(days=behind)))
        got.update({(r["authority"], r["plan_id"]): (r["execution"], r["confirmation"], r["events"]) for r in states.collect()})
    assert got == want
    assert G.plan_states(events.limit(0), F.lit(DAY)).count() == 0


def test_authority_states(spark):
    events = spark.createDataFrame([(n, d, p, n * 10 + e, ts, k) for n, steps in enumerate([
        history((7, 0, "EXPECTED")), history((7, 0, "ESTIMATE")), history((7, 0, "CONFIRMED")), history((7, 0, "EXPECTED"), (7, 0, "REJECTED")), history((7, 0, "CONFIRMED"))]) for _, d, p, e, ts, k in steps], SCHEMA)
    blocked = spark.createDataFrame([(4, True)], "authority long, blocked boolean")
    got = {r["authority"]: (r["status"], r["allowed"]) for r in G.authority_states(events, G.plan_states(events, F.lit(DAY + datetime.timedelta(days=8))), blocked).collect()}
    assert got == {0: ("EXECUTION_SESSION_MISSED", False), 1: ("BROKER_CONFIRMATION_OVERDUE", False), 2: ("CONFIRMED", True), 3: ("FEEDBACK_REJECTED", False), 4: ("COST_MODEL_RECALIBRATION_REQUIRED", False)}


@pytest.mark.parametrize("per_trigger", [None, 2])
def test_stream_equals_batch_whatever_the_order_of_files(spark, tmp_path, per_trigger):
    """Events dealt over files at random; with several triggers the watermark is wide enough that none is late."""
    batch = plan_events(spark.read.parquet(f"{SF}/events.parquet")).drop("value").withColumn("ts", F.col("ts").cast("timestamp"))
    path, rng = tmp_path / "in", random.Random(3)
    batch.repartition(4, "event_id").write.parquet(str(path))
    for n, file in enumerate(rng.sample(sorted(Path(path).glob("*.parquet")), 4)):
        os.utime(file, (1_600_000_000 + n, 1_600_000_000 + n))
    reader = spark.readStream.schema(batch.schema)
    raw = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(str(path))
    wait = "2 hours" if per_trigger is None else "20 days"
    stream = S.plan_ledger(raw.withWatermark("ts", wait).dropDuplicatesWithinWatermark(["event_id"]))
    query = stream.writeStream.format("memory").queryName(f"plans_{per_trigger}").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert T.dropped_rows(query) == 0
    mark = batch.agg((F.max("ts") - F.expr(f"INTERVAL {wait}")).alias("t")).first()["t"].replace(microsecond=0)
    last = {}
    for r in spark.table(f"plans_{per_trigger}").collect():
        k = (r["authority"], r["day"], r["plan_id"])
        last[k] = max(last.get(k, (0,)), (r["version"], r["execution"] or "", r["confirmation"] or "", r["events"]))
    want = {(r["authority"], r["day"], r["plan_id"]): (r["execution"] or "", r["confirmation"] or "", r["events"]) for r in G.plan_states(batch.where(F.col("ts") < F.lit(mark)), F.lit(mark.date())).collect()}
    assert {k: v[1:] for k, v in last.items()} == want and len(want) > 20
