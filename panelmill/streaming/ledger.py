"""The plan ledger as a stateful operator: plans change as event time passes, whatever order events arrive in."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelmill.operators.ledger import FEEDBACK, MISSED_DAYS, PENDING_DAYS, PLAN

OUTPUT = "authority long, day date, plan_id long, version long, execution string, confirmation string, events long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class PlanLedger(StatefulProcessor):
    """State of the plans of one authority and day.

    Events wait under (microsecond, event_id) until the watermark has passed them and are then applied in that order, so
    files in any order give one result and a repeated event of equal time counts once. Timers stand at the first waiting event
    and where MISSED_DAYS and PENDING_DAYS have gone by; after keep_days the group's state is dropped.
    """

    def __init__(self, keep_days: int):
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, event_id long", "plan_id long, kind string")
        self.plans = handle.getMapState("plans", "plan_id long", "version long, execution string, confirmation string, events long")
        self.open = handle.getMapState("open", "plan_id long", "since long")
        self.pending = handle.getMapState("pending", "plan_id long", "since long")

    def _deadlines(self, key: tuple) -> dict[str, int]:
        """First millisecond at which the day is more than so many days behind."""
        start = int(pd.Timestamp(key[1]).value // 1_000_000)
        return {"missed": start + (MISSED_DAYS + 1) * DAY_MS, "overdue": start + (PENDING_DAYS + 1) * DAY_MS, "dropped": start + self.keep_days * DAY_MS}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for us, event, plan, kind in zip(batch["us"].tolist(), batch["event_id"].tolist(), batch["plan_id"].tolist(), batch["kind"].tolist(), strict=True):
                self.waiting.updateValue((us, event), (plan, kind))
        now = timerValues.getCurrentWatermarkInMs()
        for ms in self._deadlines(key).values():
            if ms > now:
                self.handle.registerTimer(ms)
        yield from self._apply(key, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._apply(key, timerValues.getCurrentWatermarkInMs())

    def _apply(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        """Apply what the watermark has passed, set a timer at the first event that still waits, and return the changed plans."""
        changed: dict[int, list] = {}
        due, first = [], None
        for at, event in self.waiting.iterator():
            ms = at[0] // 1000 + 1
            if ms <= now:
                due.append((at, event))
            elif first is None or ms < first:
                first = ms
        for at, (plan, kind) in sorted(due):
            self._event(key, at[0], int(plan), kind, changed)
            self.waiting.removeKey(at)
        if first is not None:
            self.handle.registerTimer(first)
        deadlines = self._deadlines(key)
        for what, places, field in (("missed", self.open, 1), ("overdue", self.pending, 2)):
            for (plan,) in list(places.keys()) if now >= deadlines[what] else ():
                state = changed.get(int(plan)) or self._stored(int(plan))
                if state[field] != what.upper():
                    state[field] = what.upper()
                    changed[int(plan)] = state
        for plan, state in changed.items():
            state[0] += 1
            self.plans.updateValue((plan,), tuple(state))
        if changed:
            yield pd.DataFrame([(*key, plan, *state) for plan, state in changed.items()], columns=[c.split()[0] for c in OUTPUT.split(", ")])
        if now >= deadlines["dropped"] and first is None:
            for part in (self.plans, self.open, self.pending):
                part.clear()

    def _stored(self, plan: int) -> list:
        return list(self.plans.getValue((plan,))) if self.plans.containsKey((plan,)) else [0, None, None, 0]

    def _plan(self, plan: int, changed: dict[int, list]) -> list:
        if plan not in changed:
            changed[plan] = self._stored(plan)
        return changed[plan]

    def _event(self, key: tuple, us: int, plan: int, kind: str, changed: dict[int, list]) -> None:
        state = self._plan(plan, changed)
        state[3] += 1
        if kind == "EXPECTED" and state[1] is None:
            if datetime.date(1970, 1, 1) + datetime.timedelta(microseconds=us) <= key[1]:
                for (other,) in list(self.open.keys()):
                    self._plan(int(other), changed)[1] = "SUPERSEDED"
                    self.open.removeKey((int(other),))
            state[1] = "EXPECTED"
            self.open.updateValue((plan,), (us,))
        elif kind in FEEDBACK and self.open.containsKey((plan,)):
            state[1] = "OBSERVED"
            self.open.removeKey((plan,))
        if kind == "ESTIMATE":
            if not self.pending.containsKey((plan,)):
                state[2] = "PENDING"
                self.pending.updateValue((plan,), (us,))
        elif kind == "CONFIRMED":
            state[2] = "CONFIRMED"
            self.pending.removeKey((plan,))


def plan_ledger(events: DataFrame, keep_days: int = 365) -> DataFrame:
    """Changes of plans (update mode): authority, day, plan_id, version (rising with each change), execution, confirmation, events.

    events: a stream with a watermark on ts and the columns of operators.ledger, each event_id once. The last version of a
    plan is its row in plan_states over the events behind the watermark. Needs the RocksDB state store, which is set on the
    session unless another one is.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.dropna(subset=[*PLAN, "event_id", "ts"]).selectExpr(*[f"CAST({c} AS {t})" for c, t in (("authority", "long"), ("day", "date"), ("plan_id", "long"), ("event_id", "long"))], "unix_micros(ts) AS us", "ts", "kind")
    return rows.groupBy("authority", "day").transformWithStateInPandas(PlanLedger(keep_days), OUTPUT, "Update", "EventTime")
