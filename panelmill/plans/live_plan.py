"""Live performance: a second run beside the record of the first, verdicts on current models, and a history merged by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.operators import live as L
from panelmill.plans.sql import BARS, BENCH, with_
from panelmill.sources import bars as B

_GROUP, _SIZE = "(CAST(substr(code, 7) AS INT) % 5 + 1)", "(CAST(substr(code, 7) AS INT) % 7 % 5 + 1)"
#: Two runs of every instrument's value path, with faults by its brand, as SQL that both engines run; the rules are written apart for each.
SETS = {
    "paths": f"SELECT code, date, own AS strategy_nav, market AS benchmark_nav, round(own / market, 8) AS relative_nav, CASE WHEN date >= (CASE WHEN {_GROUP} = 4 THEN DATE '2001-10-20' ELSE DATE '2001-01-01' END) THEN 'v2' ELSE 'v1' END AS model, CASE extract(DAY FROM date) % 4 WHEN 0 THEN 'MODEL_ESTIMATE_PENDING' WHEN 1 THEN 'BROKER_RECONCILED' WHEN 2 THEN 'NO_EXECUTION_REQUIRED' ELSE 'UNKNOWN' END AS evidence FROM (SELECT code, x.date, round(close + 200000 * {_SIZE} * {_SIZE}, 7) AS own, round(bench + 200000 * {_SIZE} * {_SIZE}, 7) AS market FROM {{bars}} x JOIN {{bm}} y ON x.date = y.date)",
    "first_run": "SELECT * FROM {paths} WHERE date <= DATE '2001-06-01'",
    "second_run": f"SELECT code, date, strategy_nav + CASE WHEN {_GROUP} = 2 AND date BETWEEN DATE '2001-03-01' AND DATE '2001-06-01' THEN 1 ELSE 0 END AS strategy_nav, benchmark_nav, relative_nav, model, evidence FROM {{paths}} WHERE NOT ({_GROUP} = 1 AND {_SIZE} < 4 AND date > DATE '2001-03-01') AND NOT ({_GROUP} = 5 AND {_SIZE} > 3 AND date < DATE '2000-01-01')",
    "first_base": "SELECT code, min(date) AS date, CAST(1 AS DOUBLE) AS nav FROM {paths} GROUP BY code",
    "second_base": f"SELECT code, date, nav + CASE WHEN {_GROUP} = 3 AND {_SIZE} < 3 THEN 1 ELSE 0 END AS nav FROM {{first_base}}",
    "models": f"SELECT code, CASE WHEN {_GROUP} = 5 THEN 'v3' ELSE 'v2' END AS model, CASE WHEN {_SIZE} % 2 = 0 THEN DATE '2001-11-04' ELSE DATE '2001-10-01' END AS generated, DATE '2001-11-08' AS today, CASE WHEN {_SIZE} = 3 THEN DATE '2001-10-25' WHEN {_SIZE} = 5 AND {_GROUP} = 1 THEN DATE '2001-11-08' END AS expected FROM {{first_base}}",
}


def _sets(spark, sf_dir):
    found = {"bars": B.daily_bars(spark, sf_dir), "bm": B.benchmark(spark, sf_dir)}
    for name, text in SETS.items():
        found[name] = spark.sql(text, **{k: v for k, v in found.items() if "{" + k + "}" in text})
    return found


def live_continuity(spark, sf_dir):
    """The record of each instrument's second run, and what breaks its continuity with the first."""
    s = _sets(spark, sf_dir)
    prior = L.records(L.observations(s["first_run"]), s["first_base"])
    found = L.continuity(L.observations(s["second_run"]), s["second_base"], prior)
    return found.withColumn("findings", F.array_join("findings", ","))


def live_verdicts(spark, sf_dir):
    """Status of each instrument's current model after its second run: path, falls, returns, reasons, authority."""
    s = _sets(spark, sf_dir)
    prior = L.records(L.observations(s["first_run"]), s["first_base"])
    # A part of the codes has no run before.
    found = L.audit(s["second_run"], s["second_base"], s["models"], prior.where(f"{_GROUP} <> 2 AND {_GROUP} + {_SIZE} > 5"))
    return found.select("code", "current", "own_fall", "relative_fall", "return_20", "return_60", *[F.array_join(c, ",").alias(c) for c in ("hard", "soft")], "status", "allowed", "recalibrate")


def environment_history(spark, sf_dir):
    """The last 365 days of each instrument after a second run has replaced some days of the first and added others."""
    s = _sets(spark, sf_dir)
    columns = ["code", "date", "strategy_nav", "evidence"]
    return L.merged_history(s["first_run"].select(*columns), s["second_run"].select(*columns).where("date >= DATE '2001-02-01'"), ["code"], "date")


_NAMES = {k: k for k in ("bars", "bm", *SETS)}
_BOTH = with_(BARS, BENCH, *[f"{k} AS ({v.format(**_NAMES)})" for k, v in SETS.items()])
_ID = """sha256('{"benchmark_nav":' || benchmark_nav || ',"date":"' || date || '","evidence":"' || evidence || '","model":"' || model || '","relative_nav":' || relative_nav || ',"strategy_nav":' || strategy_nav || '}')"""
_FINDINGS = f""", o1 AS (SELECT code, date, {_ID} AS id FROM first_run), o2 AS (SELECT code, date, evidence, {_ID} AS id FROM second_run),
r1 AS (SELECT code, count(*) AS n, max(date) AS day, arg_max(id, date) AS id FROM o1 GROUP BY code),
r2 AS (SELECT code, count(*) AS n, max(date) AS day, arg_max(id, date) AS id FROM o2 GROUP BY code),
g1 AS (SELECT code, sha256('{{"date":"' || date || '","nav":' || nav || '}}') AS b FROM first_base), g2 AS (SELECT code, sha256('{{"date":"' || date || '","nav":' || nav || '}}') AS b FROM second_base),
beside AS (SELECT r2.code, g2.b AS baseline_id, r2.id AS latest_id, r2.day AS latest_date, r2.n AS observations,
  g1.b <> g2.b AS reset, r2.n < r1.n AS fewer, r2.day < r1.day AS back,
  r2.day > r1.day AND NOT EXISTS (FROM o2 WHERE o2.code = r2.code AND o2.id = r1.id) AND NOT EXISTS (FROM o2 WHERE o2.code = r2.code AND o2.date = r1.day AND evidence <> 'UNKNOWN') AS torn
  FROM r2 LEFT JOIN r1 USING (code) LEFT JOIN g1 USING (code) LEFT JOIN g2 USING (code)),
said AS (SELECT code, baseline_id, latest_id, latest_date, observations, concat_ws(',', if(reset, 'LIVE_PERFORMANCE_BASELINE_RESET', NULL), if(fewer, 'LIVE_PERFORMANCE_OBSERVATION_COUNT_ROLLBACK', NULL),
  if(back, 'LIVE_PERFORMANCE_HISTORY_DATE_ROLLBACK', NULL), if(torn, 'LIVE_PERFORMANCE_HISTORY_CONTINUITY_BROKEN', NULL)) AS findings FROM beside)
"""
CONTINUITY_SQL = _BOTH + _FINDINGS + "SELECT * FROM said"
VERDICT_SQL = _BOTH + _FINDINGS + f""", tail AS (SELECT s.*, row_number() OVER (PARTITION BY s.code ORDER BY date DESC) AS back FROM second_run s JOIN models m ON s.code = m.code
  WHERE s.model = m.model AND NOT EXISTS (FROM second_run z WHERE z.code = s.code AND z.date > s.date AND z.model <> m.model)),
peaks AS (SELECT *, max(strategy_nav) OVER w AS top, max(relative_nav) OVER w AS rtop FROM tail WINDOW w AS (PARTITION BY code ORDER BY date)),
sums AS (SELECT code, count(*) AS current, min(strategy_nav / top - 1) AS f, min(relative_nav / rtop - 1) AS rf, arg_max(evidence, date) AS ev,
  max(relative_nav) FILTER (back = 1) / max(relative_nav) FILTER (back = 21) - 1 AS r20, max(relative_nav) FILTER (back = 1) / max(relative_nav) FILTER (back = 61) - 1 AS r60 FROM peaks GROUP BY code),
j AS (SELECT m.code, m.expected, m.today, coalesce(current, 0) AS current, f, rf, ev, r20, r60, latest_date, date_diff('day', generated, today) < 7 AS cooling,
  coalesce(findings, '') <> '' AND {_GROUP.replace("code", "m.code")} <> 2 AND {_GROUP.replace("code", "m.code")} + {_SIZE.replace("code", "m.code")} > 5 AS wrong, latest_date IS NULL AS unseen,
  concat_ws(',', if(rf <= -0.1, 'LIVE_RELATIVE_DRAWDOWN_BREACH', NULL), if(f <= -0.15, 'LIVE_STRATEGY_DRAWDOWN_BREACH', NULL)) AS hard,
  concat_ws(',', if(r20 <= -0.05, 'LIVE_ROLLING_20_RELATIVE_UNDERPERFORMANCE', NULL), if(r60 <= -0.08, 'LIVE_ROLLING_60_RELATIVE_UNDERPERFORMANCE', NULL)) AS soft
  FROM models m LEFT JOIN said USING (code) LEFT JOIN sums USING (code)),
k AS (SELECT *, CASE WHEN wrong THEN 'LIVE_PERFORMANCE_EVIDENCE_REJECTED'
  WHEN unseen THEN if(coalesce(date_diff('day', expected, today) > 1, false), 'LIVE_PERFORMANCE_SESSION_MISSED', 'NO_LIVE_PERFORMANCE_EVIDENCE')
  WHEN current = 0 THEN if(coalesce(latest_date >= expected, false), 'LIVE_PERFORMANCE_MODEL_SESSION_MISMATCH', 'WARMUP_CURRENT_MODEL_NOT_OBSERVED')
  WHEN latest_date >= expected AND ev NOT IN ('BROKER_RECONCILED', 'NO_EXECUTION_REQUIRED') THEN if(ev = 'UNKNOWN', 'LIVE_PERFORMANCE_STATE_EVIDENCE_NOT_FINAL', 'LIVE_PERFORMANCE_BROKER_RECONCILIATION_PENDING')
  WHEN hard <> '' THEN 'LIVE_RISK_LIMIT_BREACH' WHEN soft <> '' THEN if(cooling, 'WATCH_RECALIBRATION_COOLDOWN', 'LIVE_MODEL_RECALIBRATION_REQUIRED') WHEN current < 20 THEN 'WARMUP' ELSE 'ACTIVE' END AS status FROM j)
SELECT code, current, round(f, 8) AS own_fall, round(rf, 8) AS relative_fall, round(r20, 8) AS return_20, round(r60, 8) AS return_60, hard, soft, status,
  CASE WHEN status LIKE '%NOT_FINAL' OR status LIKE '%_PENDING' THEN today <= expected ELSE status NOT IN ('LIVE_PERFORMANCE_EVIDENCE_REJECTED', 'LIVE_PERFORMANCE_SESSION_MISSED', 'LIVE_PERFORMANCE_MODEL_SESSION_MISMATCH', 'LIVE_RISK_LIMIT_BREACH') END AS allowed,
  NOT cooling AND status IN ('LIVE_RISK_LIMIT_BREACH', 'LIVE_MODEL_RECALIBRATION_REQUIRED') AS recalibrate FROM k"""
HISTORY_SQL = _BOTH + """SELECT code, date, strategy_nav, evidence FROM (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY run DESC) AS r FROM (
  SELECT code, date, strategy_nav, evidence, 0 AS run FROM first_run UNION ALL SELECT code, date, strategy_nav, evidence, 1 AS run FROM second_run WHERE date >= DATE '2001-02-01')) WHERE r = 1
QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 365"""

QUERIES = {f.__name__: f for f in (live_continuity, live_verdicts, environment_history)}
ORACLES = dict(zip(QUERIES, (CONTINUITY_SQL, VERDICT_SQL, HISTORY_SQL), strict=True))
