"""Plans and their feedback as a ledger. The events of a user in one week are the plan of that user, executed on Wednesday."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.operators import events as E
from panelmill.operators import ledger as G
from panelmill.sources import bars as B

#: Kinds of ledger events by event type.
KINDS = {"view": "ESTIMATE", "click": "EXPECTED", "purchase": "CONFIRMED", "refund": "REJECTED", "signup": "NO_ORDERS", "error": "REJECTED"}
KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE 'NO_ORDERS' END"


def plan_events(events):
    """Events of the given table in the ledger's form."""
    return events.select((F.col("user_id") % 20).alias("authority"), F.date_add(F.to_date(F.date_trunc("week", "ts")), 2).alias("day"), F.col("user_id").alias("plan_id"), "event_id", "ts", F.expr(KIND).alias("kind"), "value")


def _today(events):
    """The date of the newest event, as a scalar of the plan."""
    return events.agg(F.max(F.to_date("ts"))).scalar()


def plan_ledger(spark, sf_dir):
    """Every plan with its execution and confirmation."""
    events = B.table(spark, sf_dir, "events")
    return G.plan_states(plan_events(events), _today(events))


def authority_ledger(spark, sf_dir):
    """Every authority with the state of its plans; three confirmed plans in a row that cost far more than the model latch a block."""
    events = B.table(spark, sf_dir, "events")
    rows = plan_events(events)
    samples = rows.where("kind = 'CONFIRMED'").select("authority", "day", "event_id", (F.col("value") * 100).alias("gross"), (F.col("value") * 0.05).alias("expected"), (F.col("value") * (0.04 + (F.col("event_id") % 7) * 0.01)).alias("actual"))
    blocked = E.degraded_runs(samples, "authority", ["day", "event_id"]).groupBy("authority").agg(F.bool_or("degraded").alias("blocked"))
    return G.authority_states(rows, G.plan_states(rows, _today(events)), blocked)


PLANS_SQL = f"""WITH ev AS (SELECT user_id % 20 AS authority, CAST(date_trunc('week', ts) AS DATE) + 2 AS day, user_id AS plan_id, event_id, ts, {KIND} AS kind, value FROM events),
o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM ev),
p AS (SELECT *, opened_on <= day AS timely FROM (SELECT authority, day, plan_id, min(n) FILTER (kind = 'EXPECTED') AS opened, arg_min(CAST(ts AS DATE), n) FILTER (kind = 'EXPECTED') AS opened_on, count(*) AS events,
  arg_max(kind, n) FILTER (kind IN ('ESTIMATE', 'CONFIRMED')) AS booked FROM o GROUP BY authority, day, plan_id)),
r AS (SELECT p.*, (SELECT min(q.opened) FROM p q WHERE q.authority = p.authority AND q.day = p.day AND q.timely AND q.opened > p.opened) AS replaced FROM p),
s AS (SELECT r.*, EXISTS (SELECT 1 FROM o WHERE o.authority = r.authority AND o.day = r.day AND o.plan_id = r.plan_id AND o.kind IN ('ESTIMATE', 'CONFIRMED', 'NO_ORDERS') AND o.n > r.opened AND o.n < coalesce(r.replaced, 9e18)) AS seen,
  (SELECT max(CAST(ts AS DATE)) FROM events) - day AS behind FROM r),
plans AS (SELECT authority, day, plan_id, CASE WHEN opened IS NULL THEN NULL WHEN seen THEN 'OBSERVED' WHEN replaced IS NOT NULL THEN 'SUPERSEDED' WHEN behind > 1 THEN 'MISSED' ELSE 'EXPECTED' END AS execution,
  CASE WHEN booked = 'ESTIMATE' THEN CASE WHEN behind > 7 THEN 'OVERDUE' ELSE 'PENDING' END ELSE booked END AS confirmation, events FROM s)
"""

AUTHORITY_SQL = PLANS_SQL + """, d AS (SELECT authority, count(*) OVER w = 3 AND bool_and(actual > 1.25::DOUBLE * expected) OVER w AND sum(gross) OVER w >= 5000 AND sum(actual - expected) OVER w / sum(gross) OVER w * 10000 >= 2 AS bad FROM (
    SELECT authority, day, event_id, value * 100 AS gross, value * 0.05::DOUBLE AS expected, value * (0.04::DOUBLE + (event_id % 7) * 0.01::DOUBLE) AS actual FROM ev WHERE kind = 'CONFIRMED')
  WINDOW w AS (PARTITION BY authority ORDER BY day, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
a AS (SELECT authority, count(*) FILTER (execution = 'EXPECTED') AS expected, count(*) FILTER (execution = 'SUPERSEDED') AS superseded, count(*) FILTER (execution = 'OBSERVED') AS observed, count(*) FILTER (execution = 'MISSED') AS missed,
  count(*) FILTER (confirmation = 'PENDING') AS pending, count(*) FILTER (confirmation = 'OVERDUE') AS overdue FROM plans GROUP BY 1),
j AS (SELECT a.*, l.last_kind, coalesce(b.blocked, false) AS blocked FROM a JOIN (SELECT authority, arg_max(kind, n) AS last_kind FROM o GROUP BY 1) l USING (authority) LEFT JOIN (SELECT authority, bool_or(bad) AS blocked FROM d GROUP BY 1) b USING (authority))
SELECT *, CASE WHEN blocked THEN 'COST_MODEL_RECALIBRATION_REQUIRED' WHEN last_kind = 'REJECTED' THEN 'FEEDBACK_REJECTED' WHEN missed > 0 THEN 'EXECUTION_SESSION_MISSED' WHEN overdue > 0 THEN 'BROKER_CONFIRMATION_OVERDUE' ELSE last_kind END AS status,
  NOT blocked AND last_kind <> 'REJECTED' AND missed = 0 AND overdue = 0 AS allowed FROM j"""

QUERIES = {"plan_ledger": plan_ledger, "authority_ledger": authority_ledger}
ORACLES = {"plan_ledger": PLANS_SQL + "SELECT * FROM plans", "authority_ledger": AUTHORITY_SQL}
