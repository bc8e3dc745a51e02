"""Streams end in what the batch operators give."""

import os
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators import events as E
from panelmill.streaming import events as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path_factory.mktemp("events"))
    batch.repartitionByRange(3, "ts").write.mode("overwrite").parquet(path)
    return batch, path


def drain(stream, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect(), T.dropped_rows(query)


@pytest.mark.parametrize(("kind", "length"), [("bars", "1 day"), ("breadth", "7 days"), ("sessions", None)])
def test_stream_equals_batch(spark, source, kind, length):
    batch, path = source
    events = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    # Append mode holds windows back until the watermark, two hours behind the last event, has passed their end.
    passed = events.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("t")).first()["t"]
    want = {"bars": E.tumbling_bars, "breadth": E.sliding_breadth, "sessions": E.sessions}[kind](events)
    end = F.col("start") + F.expr(f"INTERVAL {length}") if length else F.col("end")
    got, dropped = drain(getattr(T, kind)(T.event_stream(spark, path, batch.schema)), "append", f"s_{kind}")
    assert dropped == 0 and got
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want.where(end <= F.lit(passed)).collect()), key=repr)


def test_ledger_counts(spark, source):
    batch, path = source
    rows, dropped = drain(T.ledger(T.event_stream(spark, path, batch.schema)), "update", "s_ledger")
    last = {}
    for r in rows:
        last[r["user_id"]] = max(last.get(r["user_id"], (0, 0)), (r["plans"], r["purchases"]))
    want = {r["user_id"]: (r["n"], r["p"]) for r in batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("p")).collect()}
    assert dropped == 0 and last == want


def test_late_rows_are_counted(spark, tmp_path):
    """Three files, the latest events first: what the watermark drops is told, and nothing is dropped when all are read at once."""
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("third", F.ntile(3).over(Window.orderBy("ts")))
    (tmp_path / "all").mkdir()
    for third in (3, 2, 1):
        batch.where(F.col("third") == third).drop("third").coalesce(1).write.parquet(f"{tmp_path}/{third}")
        (file,) = Path(f"{tmp_path}/{third}").glob("*.parquet")
        when = 1_600_000_000 - third * 100
        os.utime(file.rename(tmp_path / "all" / f"{third}.parquet"), (when, when))
    schema = batch.drop("third").schema
    _, dropped = drain(T.ledger(T.event_stream(spark, f"{tmp_path}/all", schema, 1)), "update", "s_late")
    assert dropped > 0
    _, dropped = drain(T.ledger(T.event_stream(spark, f"{tmp_path}/all", schema)), "update", "s_whole")
    assert dropped == 0
