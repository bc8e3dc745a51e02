"""Plans, their executions and confirmations: the state of each plan after a history of events, and of each authority.

Events: authority, day (date of execution), plan_id, event_id, ts, kind. Events are ordered by (ts, event_id).
Kinds: EXPECTED announces an execution, ESTIMATE books it by the model, CONFIRMED by the broker, NO_ORDERS tells
that none was needed, REJECTED is evidence that does not hold and changes nothing but the authority's status.

- Execution. The first EXPECTED of a plan opens it; if it comes no later than its day, it supersedes whatever its
  authority still has open for that day. The first ESTIMATE, CONFIRMED or NO_ORDERS while it is open makes it
  OBSERVED. What stays open is MISSED once a later day is more than MISSED_DAYS behind, else EXPECTED. A plan that
  was superseded or observed is not opened again.
- Confirmation. An ESTIMATE makes a plan PENDING, a CONFIRMED makes it CONFIRMED; PENDING is OVERDUE once its day
  is more than PENDING_DAYS behind.

Defined results: an event_id that comes again counts once, at its earliest time; events with a null in a key, id or
time belong to no plan and are left out; unknown kinds only count as events; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING_DAYS, MISSED_DAYS = 7, 1
FEEDBACK = ("ESTIMATE", "CONFIRMED", "NO_ORDERS")
PLAN = ["authority", "day", "plan_id"]


def once(events: DataFrame) -> DataFrame:
    """Each event_id once, at its earliest time; only what a plan can be told of."""
    whole = events.select(*PLAN, "event_id", "ts", "kind").dropna(subset=[*PLAN, "event_id", "ts"])
    first = whole.groupBy("event_id").agg(F.min(F.struct("ts", *PLAN, "kind")).alias("e"))
    return first.select("event_id", "e.*")


def _between(at: Column, low: Column, high: Column) -> Column:
    return (at > low) & (high.isNull() | (at < high))


def plan_states(events: DataFrame, today: Column) -> DataFrame:
    """One row per plan: authority, day, plan_id, execution, confirmation (null where it has none), events; today is a date.

    Events shuffle by id and by plan; only one row a plan goes on to its neighbours of the same authority and day.
    """
    at, kind = F.struct("ts", "event_id"), F.col("kind")
    opened = F.min(F.when(kind == "EXPECTED", at)).over(Window.partitionBy(*PLAN))
    rows = once(events).withColumn("at", at).withColumn("opened", opened)
    plans = rows.groupBy(*PLAN).agg(
        F.first("opened").alias("opened"),
        F.min(F.when(kind.isin(*FEEDBACK) & (F.col("at") > F.col("opened")), F.col("at"))).alias("seen"),
        F.max(F.when(kind == "ESTIMATE", F.col("at"))).alias("estimated"),
        F.max(F.when(kind == "CONFIRMED", F.col("at"))).alias("confirmed"),
        F.count(F.lit(1)).alias("events"),
    )
    timely = F.to_date(F.col("opened.ts")) <= F.col("day")
    # From the last to the first, as frames that grow are linear and those that shrink are not.
    later = Window.partitionBy("authority", "day").orderBy(F.col("opened").desc_nulls_last(), "plan_id").rowsBetween(Window.unboundedPreceding, -1)
    plans = plans.withColumn("replaced", F.min(F.when(timely, F.col("opened"))).over(later))
    behind = F.datediff(today, "day")
    execution = (
        F.when(F.col("opened").isNull(), None)
        .when(_between(F.col("seen"), F.col("opened"), F.col("replaced")), "OBSERVED")
        .when(F.col("replaced").isNotNull(), "SUPERSEDED")
        .when(behind > MISSED_DAYS, "MISSED")
        .otherwise("EXPECTED")
    )
    pending = F.col("estimated").isNotNull() & (F.col("confirmed").isNull() | (F.col("estimated") > F.col("confirmed")))
    confirmation = F.when(pending, F.when(behind > PENDING_DAYS, "OVERDUE").otherwise("PENDING")).when(F.col("confirmed").isNotNull(), "CONFIRMED")
    return plans.select(*PLAN, execution.alias("execution"), confirmation.alias("confirmation"), "events")


def authority_states(events: DataFrame, plans: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row per authority: counts of its plans, status and whether it may act. The worst of block, rejected evidence, missed
    executions and overdue confirmations decides, else the kind of the last event. plans: plan_states; blocked: authority, blocked (a latch).
    """
    last = once(events).groupBy("authority").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"))
    counts = plans.groupBy("authority").agg(
        *[F.count_if(F.col("execution") == e).alias(e.lower()) for e in ("EXPECTED", "SUPERSEDED", "OBSERVED", "MISSED")],
        *[F.count_if(F.col("confirmation") == c).alias(c.lower()) for c in ("PENDING", "OVERDUE")],
    )
    status = (
        F.when(F.col("blocked"), "COST_MODEL_RECALIBRATION_REQUIRED")
        .when(F.col("last_kind") == "REJECTED", "FEEDBACK_REJECTED")
        .when(F.col("missed") > 0, "EXECUTION_SESSION_MISSED")
        .when(F.col("overdue") > 0, "BROKER_CONFIRMATION_OVERDUE")
        .otherwise(F.col("last_kind"))
    )
    out = counts.join(last, "authority").join(blocked, "authority", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False))).withColumn("status", status)
    allowed = ~F.col("blocked") & (F.col("last_kind") != "REJECTED") & (F.col("missed") == 0) & (F.col("overdue") == 0)
    return out.withColumn("allowed", F.coalesce(allowed, F.lit(False)))
