"""Event windows, ledgers, audits and governance checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators import events as E
from panelmill.sources import bars as B


def _events(spark, sf_dir):
    return B.table(spark, sf_dir, "events")


def event_bars_tumbling(spark, sf_dir):
    return E.tumbling_bars(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("date"))


BARS_SQL = "SELECT CAST(ts AS DATE) AS start, event_type, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS events FROM events GROUP BY 1, 2"


def event_breadth_sliding(spark, sf_dir):
    return E.sliding_breadth(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("date"))


BREADTH_SQL = """SELECT start, count(*) AS events, count(*) FILTER (value > 50) AS above, round((2 * count(*) FILTER (value > 50) - count(*)) / count(*), 6) AS breadth FROM (
  SELECT value, CAST(CAST(ts AS DATE) - CAST(k AS INT) AS DATE) AS start FROM events, (SELECT unnest(generate_series(0, 6)) AS k)) GROUP BY 1"""


def event_sessions(spark, sf_dir):
    return E.sessions(_events(spark, sf_dir)).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


SESSION_SQL = """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM (SELECT *, sum(CASE WHEN ts < p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s"""


def weighted_p75(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_type", "value", (1 + F.col("user_id") % 5).alias("weight"))
    return E.weighted_quantile(rows, "event_type", "value", "weight", 0.75)


P75_SQL = """SELECT event_type, min(value) AS quantile FROM (SELECT event_type, value, sum(w) OVER (PARTITION BY event_type ORDER BY value) AS c, sum(w) OVER (PARTITION BY event_type) AS t FROM (
  SELECT event_type, value, sum(1 + user_id % 5) AS w FROM events GROUP BY 1, 2)) WHERE c >= 0.75::DOUBLE * t GROUP BY 1"""


def cost_degradation_latch(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("value") * 100).alias("gross"), (F.col("value") * 0.05).alias("expected"), (F.col("value") * (0.04 + (F.col("event_id") % 7) * 0.01)).alias("actual"))
    marked = E.degraded_runs(rows, "user_id", ["ts", "event_id"], least_gross=500.0)
    return marked.groupBy("user_id").agg(F.count_if("degraded").alias("degraded"), F.bool_or("degraded").alias("latched"))


LATCH_SQL = """SELECT user_id, count(*) FILTER (d) AS degraded, bool_or(d) AS latched FROM (
  SELECT user_id, count(*) OVER w = 3 AND bool_and(actual > 1.25::DOUBLE * expected) OVER w AND sum(gross) OVER w >= 500 AND sum(actual - expected) OVER w / sum(gross) OVER w * 10000 >= 2 AS d FROM (
    SELECT user_id, ts, event_id, value * 100 AS gross, value * 0.05::DOUBLE AS expected, value * (0.04::DOUBLE + (event_id % 7) * 0.01::DOUBLE) AS actual FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) GROUP BY 1"""


def signal_changes(spark, sf_dir):
    """Changes of a user's signal from event to event: entries, exits, stops and accelerations."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).withColumns({"was": F.lag("event_type").over(w), "before": F.lag("value").over(w)})
    kinds = F.array_compact(F.array(F.when((F.col("event_type") == "purchase") & (F.col("was") != "purchase"), "NEW_BUY"), F.when((F.col("event_type") != "purchase") & (F.col("was") == "purchase"), "NEW_SELL"), F.when(F.col("value") < F.col("before") * 0.2, "STOP_LOSS"), F.when(F.col("value") - F.col("before") > 100, "SCORE_ACCEL")))
    return rows.select("event_type", F.explode(kinds).alias("change")).groupBy("event_type", "change").agg(F.count(F.lit(1)).alias("n"))


CHANGES_SQL = """SELECT event_type, change, count(*) AS n FROM (SELECT event_type, unnest(list_filter([CASE WHEN event_type = 'purchase' AND was <> 'purchase' THEN 'NEW_BUY' END, CASE WHEN event_type <> 'purchase' AND was = 'purchase' THEN 'NEW_SELL' END,
  CASE WHEN value < before * 0.2::DOUBLE THEN 'STOP_LOSS' END, CASE WHEN value - before > 100 THEN 'SCORE_ACCEL' END], lambda x: x IS NOT NULL)) AS change FROM (
  SELECT *, lag(event_type) OVER w AS was, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2"""

RULES = {"price_positive": "o_totalprice > 1000", "known_status": "o_orderstatus IN ('O', 'F')", "priority_text": "o_orderpriority NOT LIKE '5%'"}


def contract_violations(spark, sf_dir):
    return E.violations(B.table(spark, sf_dir, "orders"), ["o_orderkey"], RULES)


VIOLATION_SQL = " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS violation FROM orders WHERE NOT coalesce({c}, false)" for k, c in RULES.items())


def ledger_state(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))
    return E.ledger(rows.withColumn("plan_id", F.col("user_id") * 1000000 + F.datediff("day", F.lit("2024-01-01").cast("date")) * 100 + F.hour("ts")))


LEDGER_SQL = """WITH e AS (SELECT *, CAST(ts AS DATE) AS day, user_id * 1000000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 100 + hour(ts) AS plan_id FROM events),
p AS (SELECT plan_id, user_id, day, count(*) AS events, arg_max(event_type, row(ts, event_id)) AS last_type, max(ts) AS last_ts FROM e GROUP BY 1, 2, 3)
SELECT plan_id, user_id, events, last_type, CASE WHEN plan_id < max(plan_id) OVER (PARTITION BY user_id, day) THEN 'SUPERSEDED' WHEN last_type = 'purchase' THEN 'OBSERVED'
  WHEN last_ts < (SELECT max(ts) FROM e) - INTERVAL 7 DAY THEN 'OVERDUE' ELSE 'PENDING' END AS state FROM p"""


def status_hysteresis(spark, sf_dir):
    level = F.least(F.floor(F.avg("value") / 20), F.lit(4)).cast("bigint")
    daily = _events(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(level.alias("level"))
    return E.hysteresis(daily.withColumnRenamed("user_id", "key"))


HYSTERESIS_SQL = """WITH RECURSIVE d AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, CAST(least(floor(avg(value) / 20), 4) AS BIGINT) AS level FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS k FROM d),
w(key, k, pub, raw, changes) AS (SELECT key, k, level, level, CAST(0 AS BIGINT) FROM n WHERE k = 1 UNION ALL
  SELECT n.key, n.k, CASE WHEN n.level <> w.pub AND (n.level = w.raw OR abs(n.level - w.pub) >= 2) THEN n.level ELSE w.pub END, n.level, w.changes + CASE WHEN n.level <> w.pub AND (n.level = w.raw OR abs(n.level - w.pub) >= 2) THEN 1 ELSE 0 END
  FROM w JOIN n ON n.key = w.key AND n.k = w.k + 1)
SELECT key, pub AS status, changes FROM (SELECT *, max(k) OVER (PARTITION BY key) AS m FROM w) WHERE k = m"""


def live_performance(spark, sf_dir):
    """Drawdown limits on a daily value path by event type: the worst verdict of each."""
    daily = _events(spark, sf_dir).groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 6).alias("nav"))
    w = Window.partitionBy("event_type").orderBy("day")
    rows = daily.withColumns({"dd": F.col("nav") / F.max("nav").over(w) - 1, "r5": F.col("nav") / F.lag("nav", 5).over(w) - 1})
    verdict = F.when(F.min("dd") < -0.15, "BLOCKED").when(F.min("r5") < -0.05, "REDUCED").otherwise("ACTIVE")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("days"), F.round(F.min("dd"), 6).alias("worst_drawdown"), F.round(F.min("r5"), 6).alias("worst_5"), verdict.alias("verdict"))


PERFORMANCE_SQL = """SELECT event_type, count(*) AS days, round(min(dd), 6) AS worst_drawdown, round(min(r5), 6) AS worst_5, CASE WHEN min(dd) < -0.15 THEN 'BLOCKED' WHEN min(r5) < -0.05 THEN 'REDUCED' ELSE 'ACTIVE' END AS verdict FROM (
  SELECT *, nav / max(nav) OVER w - 1 AS dd, nav / lag(nav, 5) OVER w - 1 AS r5 FROM (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 6) AS nav FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY day)) GROUP BY 1"""


def artifact_time_validity(spark, sf_dir):
    """Age limits of artifacts (21 days since generation, 60 since training), with the reasons for those that fail."""
    orders = B.table(spark, sf_dir, "orders")
    now = F.lit("1998-06-01").cast("date")
    generated = F.datediff(now, F.col("o_orderdate").cast("date"))
    trained = generated + (F.col("o_orderkey") % 60).cast("int")
    reasons = F.array_compact(F.array(F.when(generated < 0, "FROM_THE_FUTURE"), F.when(generated > 21, "GENERATED_TOO_OLD"), F.when(trained > 60, "TRAINED_TOO_OLD")))
    return orders.select(F.array_join(reasons, ",").alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("artifacts"))


ARTIFACT_SQL = """SELECT concat_ws(',', CASE WHEN g < 0 THEN 'FROM_THE_FUTURE' END, CASE WHEN g > 21 THEN 'GENERATED_TOO_OLD' END, CASE WHEN g + o_orderkey % 60 > 60 THEN 'TRAINED_TOO_OLD' END) AS reasons, count(*) AS artifacts
FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') AS g FROM orders) GROUP BY 1"""


def identity_hashes(spark, sf_dir):
    """SHA-256 of a canonical text of each nation's customers: compact, sorted, fixed number format."""
    rows = B.table(spark, sf_dir, "customer").select("c_nationkey", F.concat_ws(":", F.col("c_custkey").cast("string"), F.format_string("%.2f", "c_acctbal")).alias("t"), "c_custkey")
    # A tree of digests: customers, ranges of RANGE keys, the ranges' ranges, nations. No row ever gathers more than RANGE digests
    # (a nation: as many as its keys reach over RANGE squared).
    rows = rows.select("c_nationkey", F.col("c_custkey").cast("bigint").alias("k"), F.sha2("t", 256).alias("d"))
    joined = lambda: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), ","), 256)
    for _ in range(2):
        rows = rows.groupBy("c_nationkey", F.floor(F.col("k") / RANGE).alias("r")).agg(joined().alias("d")).withColumnRenamed("r", "k")
    return rows.groupBy("c_nationkey").agg(joined().alias("identity"))


RANGE = 1000
HASH_SQL = f"""SELECT c_nationkey, sha256(string_agg(d, ',' ORDER BY k)) AS identity FROM (SELECT c_nationkey, k // {RANGE} AS k, sha256(string_agg(d, ',' ORDER BY k)) AS d FROM (
  SELECT c_nationkey, c_custkey // {RANGE} AS k, sha256(string_agg(sha256(c_custkey || ':' || printf('%.2f', c_acctbal)), ',' ORDER BY c_custkey)) AS d FROM customer GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1"""

QUERIES = {f.__name__: f for f in (event_bars_tumbling, event_breadth_sliding, event_sessions, weighted_p75, cost_degradation_latch, signal_changes, contract_violations, ledger_state, status_hysteresis, live_performance, artifact_time_validity, identity_hashes)}
ORACLES = dict(zip(QUERIES, (BARS_SQL, BREADTH_SQL, SESSION_SQL, P75_SQL, LATCH_SQL, CHANGES_SQL, VIOLATION_SQL, LEDGER_SQL, HYSTERESIS_SQL, PERFORMANCE_SQL, ARTIFACT_SQL, HASH_SQL), strict=True))
