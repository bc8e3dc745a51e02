"""Reconciliation of plans and fills, continuity of runs, cut-offs, best choices and sets of names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.functions import windows as W
from panelmill.operators import factors as R
from panelmill.plans import labels_plan as L
from panelmill.plans.crosssection_plan import BASE
from panelmill.plans.sql import BARS, BENCH, SESSIONS, with_
from panelmill.sources import bars as B

#: What is wrong with an order and its fills, by name.
MISMATCHES = [
    ("PLAN_WITHOUT_FILL", "fills IS NULL"),
    ("FILL_WITHOUT_PLAN", "planned IS NULL"),
    ("VALUE_MISMATCH", "abs(filled - planned) > 0.01 * planned"),
    ("FILL_BEFORE_PLAN", "first_fill < plan_date"),
    ("PARTLY_RETURNED", "returned > 0 AND returned < fills"),
]


def fill_reconciliation(spark, sf_dir):
    """Plans (orders) against fills (line items) in one full join by key; how many keys break each rule, and how many none."""
    lines, orders = B.table(spark, sf_dir, "lineitem"), B.table(spark, sf_dir, "orders")
    fills = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("fills"), F.sum("l_extendedprice").alias("filled"), F.min(F.col("l_shipdate").cast("date")).alias("first_fill"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    plans = orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("planned"), F.col("o_orderdate").cast("date").alias("plan_date"))
    why = R.reasons(MISMATCHES)
    both = fills.join(plans, "key", "full").select(F.explode(F.when(F.size(why) == 0, F.array(F.lit("CONSISTENT"))).otherwise(why)).alias("finding"))
    return both.groupBy("finding").agg(F.count(F.lit(1)).alias("keys"))


RECONCILE_SQL = """WITH f AS (SELECT l_orderkey AS key, count(*) AS fills, sum(l_extendedprice) AS filled, min(CAST(l_shipdate AS DATE)) AS first_fill, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
j AS (SELECT * FROM f FULL JOIN (SELECT o_orderkey AS key, o_totalprice AS planned, CAST(o_orderdate AS DATE) AS plan_date FROM orders) USING (key)),
w AS (SELECT list_filter([""" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in MISMATCHES) + """], lambda x: x IS NOT NULL) AS why FROM j)
SELECT unnest(CASE WHEN len(why) = 0 THEN ['CONSISTENT'] ELSE why END) AS finding, count(*) AS keys FROM w GROUP BY 1"""


def run_continuity(spark, sf_dir):
    """Records of each user in order of their number: steps back in time, gaps of more than 30 days, and repeated times."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = B.table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    kinds = R.reasons([("DATE_ROLLBACK", "ts < before"), ("GAP", "ts > before + INTERVAL 30 DAYS"), ("REPEATED_TIME", "ts = before")])
    return rows.select("user_id", F.explode(kinds).alias("finding")).groupBy("user_id", "finding").agg(F.count(F.lit(1)).alias("n"))


CONTINUITY_SQL = """SELECT user_id, finding, count(*) AS n FROM (SELECT user_id, unnest(list_filter([CASE WHEN ts < before THEN 'DATE_ROLLBACK' END, CASE WHEN ts > before + INTERVAL 30 DAY THEN 'GAP' END, CASE WHEN ts = before THEN 'REPEATED_TIME' END], lambda x: x IS NOT NULL)) AS finding
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)) GROUP BY 1, 2"""


def trailing_run(spark, sf_dir):
    """The last unbroken run of one event type of each user: its type, length and first event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = B.table(spark, sf_dir, "events").withColumn("fresh", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("fresh").over(w))
    runs = rows.groupBy("user_id", "island").agg(F.max("event_type").alias("event_type"), F.count(F.lit(1)).alias("length"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))
    return runs.groupBy("user_id").agg(F.max_by(F.struct("event_type", "length", "first_event"), "island").alias("x")).select("user_id", "x.*")


RUN_SQL = """WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f), m AS (SELECT user_id, max(island) AS island FROM i GROUP BY 1)
SELECT user_id, max(event_type) AS event_type, count(*) AS length, arg_min(event_id, row(ts, event_id)) AS first_event FROM i JOIN m USING (user_id, island) GROUP BY 1"""

NOWS = ["1996-05-03 15:14:00", "1996-05-03 15:15:00", "1996-05-04 10:00:00", "1996-05-06 09:00:00", "1996-05-06 23:59:59"]


def session_cutoff(spark, sf_dir):
    """The last session that is complete at a given time: that of the day from 15:15 on, else the one before."""
    nows = spark.createDataFrame([(n,) for n in NOWS], "now string").withColumn("ts", F.col("now").cast("timestamp"))
    late = F.date_format("ts", "HH:mm") >= "15:15"
    nows = nows.withColumn("until", F.when(late, F.col("ts").cast("date")).otherwise(F.date_sub(F.col("ts").cast("date"), 1)))
    # As-of lookup: times and sessions in one ordered list, each time takes the last session before it.
    sessions = B.sessions(spark, sf_dir).select(F.lit(None).cast("string").alias("now"), F.col("date").alias("until"), F.col("date").alias("session"))
    both = sessions.unionByName(nows.select("now", "until", F.lit(None).cast("date").alias("session")))
    last = F.last("session", ignorenulls=True).over(Window.orderBy("until", F.col("now").asc_nulls_first()))  # one row a session
    return both.withColumn("expected", last).where("now IS NOT NULL").select("now", "expected")


CUTOFF_SQL = with_(SESSIONS) + "SELECT now, (SELECT max(date) FROM cal WHERE date <= CASE WHEN strftime(CAST(now AS TIMESTAMP), '%H:%M') >= '15:15' THEN CAST(CAST(now AS TIMESTAMP) AS DATE) ELSE CAST(CAST(now AS TIMESTAMP) AS DATE) - 1 END) AS expected FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in NOWS) + "]) AS now)"


def threshold_choice(spark, sf_dir):
    """The best thresholds of the grid that keep at least a fifth of all rows: most forward return, then fewest stops, then most rows."""
    met = L.threshold_grid(spark, sf_dir).where("retention >= 0.2")
    best = met.agg(F.max(F.struct("mean_forward", (-F.col("stopped")).alias("safe"), "kept", *[(-F.col(f"t{i}")).alias(f"n{i}") for i in range(4)])).alias("x"))
    return best.select(*[(-F.col(f"x.n{i}")).alias(f"t{i}") for i in range(4)], "x.kept", "x.mean_forward", (-F.col("x.safe")).alias("stopped"))


CHOICE_SQL = "SELECT t0, t1, t2, t3, kept, mean_forward, stopped FROM (" + L.GRID_SQL + ") WHERE retention >= 0.2 ORDER BY mean_forward DESC, stopped, kept DESC, t0, t1, t2, t3 LIMIT 1"


def relative_returns(spark, sf_dir):
    """Return over 20 and 60 records less that of the benchmark, at each instrument's last bar."""
    rows = B.numbered_bars(spark, sf_dir).join(B.benchmark(spark, sf_dir), "date").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("code")))
    rel = lambda n: F.round(F.col("close") / W.lag("close", n) - F.col("bench") / W.lag("bench", n), 6).alias(f"relative_{n}")
    return rows.select("code", "date", "n", "m", rel(20), rel(60)).where("n = m").drop("n", "m")


def _rel(n):
    return f"round(close / lag(close, {n}) OVER w - bench / lag(bench, {n}) OVER w, 6) AS relative_{n}"


RELATIVE_SQL = with_(BARS, BENCH) + f"SELECT code, date, relative_20, relative_60 FROM (SELECT code, date, n, count(*) OVER (PARTITION BY code) AS m, {_rel(20)}, {_rel(60)} FROM b JOIN bm USING (date) WINDOW w AS (PARTITION BY code ORDER BY date)) WHERE n = m"


def code_sets(spark, sf_dir):
    """Names by whether they traded in the first month, the last month, or both."""
    rows = B.session_totals(spark, sf_dir).select("code", F.trunc("date", "month").alias("month")).distinct()
    ends = rows.agg(F.min("month").alias("a"), F.max("month").alias("z"))  # one row
    both = rows.join(F.broadcast(ends)).groupBy("code").agg(F.bool_or(F.col("month") == F.col("a")).alias("first"), F.bool_or(F.col("month") == F.col("z")).alias("last"))
    kind = F.when(F.col("first") & F.col("last"), "both").when(F.col("first"), "first").when(F.col("last"), "last").otherwise("neither")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("codes"), F.sha2(F.array_join(F.sort_array(F.collect_list("code")), ","), 256).alias("digest"))  # instruments are few


SETS_SQL = with_(BARS) + """SELECT CASE WHEN f AND l THEN 'both' WHEN f THEN 'first' WHEN l THEN 'last' ELSE 'neither' END AS kind, count(*) AS codes, sha256(string_agg(code, ',' ORDER BY code)) AS digest FROM (
  SELECT code, bool_or(mo = a) AS f, bool_or(mo = z) AS l FROM (SELECT code, date_trunc('month', date)::DATE AS mo FROM bars), (SELECT min(date_trunc('month', date)::DATE) AS a, max(date_trunc('month', date)::DATE) AS z FROM bars) GROUP BY 1) GROUP BY 1"""

QUERIES = {f.__name__: f for f in (fill_reconciliation, run_continuity, trailing_run, session_cutoff, threshold_choice, relative_returns, code_sets)}
ORACLES = dict(zip(QUERIES, (RECONCILE_SQL, CONTINUITY_SQL, RUN_SQL, CUTOFF_SQL, CHOICE_SQL, RELATIVE_SQL, SETS_SQL), strict=True))
