"""Streams of events: the batch operators behind watermarks, duplicates dropped, and a stateful ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelmill.operators import events as E

LATE = "2 hours"
LEDGER = "user_id long, plans long, purchases long, open_plans long, last_ts timestamp"
STATE = "plans long, purchases long, open_plans long, last_us long"


def event_stream(spark: SparkSession, path: str, schema, files_a_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream of events with a watermark, each event_id once.

    Spark reads files by their modification times, which say nothing of event times, and drops what comes
    later than the watermark. So all files that are there are read in one trigger, and none of a backlog
    is late to another. files_a_trigger bounds a trigger where files are known to come in order of events;
    dropped_rows then tells whether that held.
    """
    reader = spark.readStream.schema(schema)
    raw = (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators of a query dropped as later than the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def bars(events: DataFrame) -> DataFrame:
    return E.tumbling_bars(events)


def breadth(events: DataFrame) -> DataFrame:
    return E.sliding_breadth(events)


def sessions(events: DataFrame) -> DataFrame:
    return E.sessions(events)


def ledger(events: DataFrame) -> DataFrame:
    """Running counts by user, kept in the state store; a user without events for 7 days of event time is closed."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plans, purchases, open_plans, last = state.get if state.exists else (0, 0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], plans, purchases, 0, pd.Timestamp(last, unit="us"))], columns=[c.split()[0] for c in LEDGER.split(", ")])
            return
        for pdf in batches:
            bought = int((pdf["event_type"] == "purchase").sum())
            plans, purchases = plans + len(pdf), purchases + bought
            open_plans = max(0, open_plans + len(pdf) - 2 * bought)
            last = max(last, int(pdf["ts"].max().value // 1000))
        state.update((plans, purchases, open_plans, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 7 * 86_400_000)
        yield pd.DataFrame([(key[0], plans, purchases, open_plans, pd.Timestamp(last, unit="us"))], columns=[c.split()[0] for c in LEDGER.split(", ")])

    return events.groupBy("user_id").applyInPandasWithState(update, LEDGER, STATE, "update", GroupStateTimeout.EventTimeTimeout)
