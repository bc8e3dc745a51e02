"""Trend, setup, risk and priority of instruments; selection of factors by their coefficient paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.functions import windows as W
from panelmill.operators import calendar as C
from panelmill.operators import rotation as R
from panelmill.operators import trend as T
from panelmill.plans import crosssection_plan as X
from panelmill.plans.indicators_plan import TR, over
from panelmill.plans.sql import BARS, BENCH, with_
from panelmill.sources import bars as B


def _rolled(spark, sf_dir, unit):
    rows = C.roll_up(B.daily_bars(spark, sf_dir), unit)
    return rows.select("code", F.col("period").alias("date"), "open", "high", "low", "close", "volume")


def monthly_trend(spark, sf_dir):
    return T.monthly_trend(_rolled(spark, sf_dir, "month"))


def weekly_trend(spark, sf_dir):
    return T.weekly_trend(_rolled(spark, sf_dir, "week"))


def _rolled_sql(unit, name):
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS n, count(*) OVER (PARTITION BY code) AS m FROM (
  SELECT code, date_trunc('{unit}', date)::DATE AS date, max(high) AS high, min(low) AS low, arg_max(close, date) AS close FROM bars GROUP BY 1, 2))"""


MONTHLY = _rolled_sql("month", "mo") + """,
me(code, n, m, close, e) AS (SELECT code, n, m, close, close FROM mo WHERE n = 1 UNION ALL SELECT b.code, b.n, b.m, b.close, r.e * (1 - 2::DOUBLE / 11) + b.close * (2::DOUBLE / 11) FROM me r JOIN mo b ON b.code = r.code AND b.n = r.n + 1),
mt AS (SELECT code, round(greatest(-1, least(1, 0.55::DOUBLE * tanh(ln(close / e) / 0.08) + 0.45::DOUBLE * tanh(ln(e / e3) / 0.06))), 6) AS monthly_score FROM (SELECT *, lag(e, 3) OVER (PARTITION BY code ORDER BY n) AS e3 FROM me) WHERE n = m AND m >= 13)"""
WEEKLY = _rolled_sql("week", "we") + f""",
wt0 AS (SELECT *, {TR} AS tr, abs(close - lag(close) OVER (PARTITION BY code ORDER BY date)) AS step FROM we),
wf(code, n, m, close, e, atr) AS (SELECT code, n, m, close, close, tr FROM wt0 WHERE n = 1 UNION ALL
  SELECT b.code, b.n, b.m, b.close, r.e * (1 - 2::DOUBLE / 21) + b.close * (2::DOUBLE / 21), r.atr * (1 - 1::DOUBLE / 14) + b.tr * (1::DOUBLE / 14) FROM wf r JOIN wt0 b ON b.code = r.code AND b.n = r.n + 1),
wp AS (SELECT code, n, sum(step) {over(13)} AS path, close - lag(close, 13) OVER (PARTITION BY code ORDER BY date) AS net FROM wt0),
wt AS (SELECT code, round(greatest(-1, least(1, 0.40::DOUBLE * tanh((close - e) / atr / 2) + 0.35::DOUBLE * tanh(ln(e / e4) / (4 * greatest(atr / close, 0.005))) + 0.25::DOUBLE * CASE WHEN path > 0 THEN greatest(-1, least(1, net / path)) ELSE 0 END)), 6) AS weekly_score
  FROM (SELECT *, lag(e, 4) OVER (PARTITION BY code ORDER BY n) AS e4 FROM wf) JOIN wp USING (code, n) WHERE n = m AND m >= 21 AND atr > 0)"""


def _setup(spark, sf_dir):
    return T.structural_risk(T.setup(T.setup_inputs(B.daily_bars(spark, sf_dir)).join(weekly_trend(spark, sf_dir), "code")))


def setup_and_risk(spark, sf_dir):
    return _setup(spark, sf_dir).select("code", "setup", "setup_score", F.round("stop_loss", 5).alias("stop_loss"), F.round("stop_pct", 4).alias("stop_pct"), "executable", "risk_quality")


def _unit(x):
    return f"greatest(0, least(1, {x}))"


SETUP = f"""d0 AS (SELECT *, {TR} AS tr, count(*) OVER (PARTITION BY code) AS m, lag(close) OVER (PARTITION BY code ORDER BY date) AS previous, max(high) {over(20, 1)} AS high20, min(low) {over(10, 1)} AS swing, avg(volume) {over(20, 1)} AS vma FROM b),
df(code, n, a5, a14, a20, e) AS (SELECT code, n, tr, tr, tr, close FROM d0 WHERE n = 1 UNION ALL SELECT b.code, b.n, {', '.join(f'r.a{k} * (1 - 1::DOUBLE / {k}) + b.tr * (1::DOUBLE / {k})' for k in (5, 14, 20))}, r.e * (1 - 2::DOUBLE / 21) + b.close * (2::DOUBLE / 21)
  FROM df r JOIN d0 b ON b.code = r.code AND b.n = r.n + 1),
si AS (SELECT d0.*, a5, a14, a20, e, weekly_score AS ws, {_unit('(close - low) / greatest(high - low, close * 1e-6)')} AS clv, CASE WHEN vma > 0 THEN volume / vma ELSE 1 END AS vr, (close - high20) / a14 AS gap, (close - e) / a14 AS dist
  FROM d0 JOIN df USING (code, n) JOIN wt USING (code) WHERE n = m AND m >= 25),
sb AS (SELECT *, CASE WHEN ws >= 0.25 AND close >= high20 AND gap BETWEEN 0 AND 1 AND clv >= 0.65 AND vr >= 1.2 THEN 100 * (0.30::DOUBLE * {_unit('1 - abs(gap - 0.25) / 0.75')} + 0.25::DOUBLE * {_unit('ln(greatest(vr, 1)) / ln(2)')} + 0.25::DOUBLE * {_unit('(clv - 0.5) / 0.5')} + 0.20::DOUBLE * {_unit('1 - a5 / greatest(a20, 1e-9)')}) ELSE 0 END AS bs,
  CASE WHEN ws >= 0.25 AND dist BETWEEN -0.75 AND 1.25 AND close > previous AND close >= open AND clv >= 0.55 AND vr <= 1.2 THEN 100 * (0.35::DOUBLE * {_unit('1 - abs(dist) / 1.5')} + 0.25::DOUBLE * {_unit('(clv - 0.5) / 0.5')} + 0.20::DOUBLE * {_unit('(1.2 - vr) / 0.7')} + 0.20::DOUBLE * {_unit('(close - previous) / a14')}) ELSE 0 END AS ps FROM si),
ss AS (SELECT *, CASE WHEN bs >= ps AND bs > 0 THEN 'BREAKOUT' WHEN ps > 0 THEN 'PULLBACK' ELSE 'NONE' END AS setup, round(greatest(bs, ps), 4) AS setup_score FROM sb),
sk AS (SELECT *, least(CASE WHEN setup = 'BREAKOUT' THEN greatest(high20 - a14, swing - 0.25 * a14) ELSE swing - 0.25 * a14 END, close - 1.2 * a14) AS stop FROM ss),
sr AS (SELECT *, (close - stop) / close * 100 AS pct, (close - stop) / a14 AS mult FROM sk),
sx AS (SELECT *, stop > 0 AND stop < close AND pct BETWEEN 2 AND 10 AS executable FROM sr),
sq AS (SELECT *, round(CASE WHEN executable THEN 100 * (0.55::DOUBLE * {_unit('1 - abs(mult - 2.2) / 1.8')} + 0.45::DOUBLE * {_unit('1 - abs(pct - 5.5) / 4.5')}) ELSE 0 END, 4) AS risk_quality FROM sx)"""
SETUP_SQL = with_(BARS, WEEKLY, SETUP) + "SELECT code, setup, setup_score, round(stop, 5) AS stop_loss, round(pct, 4) AS stop_pct, executable, risk_quality FROM sq"


def priority_score(spark, sf_dir):
    rps = R.relative_strength(B.daily_bars(spark, sf_dir), B.benchmark(spark, sf_dir)).select("code", F.col("score").alias("rps"))
    rows = _setup(spark, sf_dir).join(rps, "code", "left").join(monthly_trend(spark, sf_dir), "code", "left")
    return T.priority(rows).select("code", "priority")


RS = X.ORACLES["relative_strength"]
RS_CTES = RS[RS.index("j AS ("): RS.rindex("SELECT code, round(beta, 4)")]
RS_LAST = RS[RS.rindex("SELECT code, round(beta, 4)"):]
PRIORITY_SQL = with_(BARS, BENCH, WEEKLY, MONTHLY, SETUP, RS_CTES.rstrip().rstrip(",") + f", rps AS ({RS_LAST})") + """SELECT code, round(greatest(0, least(100, setup_score * 0.30::DOUBLE + coalesce(score, 0) * 0.30::DOUBLE + (ws + 1) * 50 * 0.25::DOUBLE + risk_quality * 0.10::DOUBLE + (coalesce(monthly_score, 0) + 1) * 50 * 0.05::DOUBLE + 1e-7)), 4) AS priority
FROM sq LEFT JOIN rps USING (code) LEFT JOIN mt USING (code)"""


def blended_return(spark, sf_dir):
    """0.4, 0.3 and 0.3 of the 20-, 60- and 120-bar returns at the last bar; shorter histories shrink the last two, below 21 bars -999."""
    rows = B.numbered_bars(spark, sf_dir).withColumn("first", F.first("close").over(W.by_code().rowsBetween(Window.unboundedPreceding, 0))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("code")))
    ret = lambda n: F.col("close") / F.coalesce(W.lag("close", n), F.col("first")) - 1
    rows = rows.withColumn("blend", 0.4 * ret(20) + 0.3 * ret(60) + 0.3 * ret(120))
    return rows.where("n = m").select("code", F.round(F.when(F.col("n") >= 21, F.col("blend")).otherwise(-999.0), 6).alias("blend"))


def _ret(n):
    return f"(close / coalesce(lag(close, {n}) OVER (PARTITION BY code ORDER BY date), first_value(close) OVER (PARTITION BY code ORDER BY date)) - 1)"


BLEND_SQL = with_(BARS) + f"SELECT code, round(CASE WHEN n >= 21 THEN bl ELSE -999 END, 6) AS blend FROM (SELECT code, n, count(*) OVER (PARTITION BY code) AS m, 0.4::DOUBLE * {_ret(20)} + 0.3::DOUBLE * {_ret(60)} + 0.3::DOUBLE * {_ret(120)} AS bl FROM b) WHERE n = m"


def subperiod_stability(spark, sf_dir):
    """Mean coefficient in three contiguous blocks of dates; a factor passes with two blocks at or above 0 and none below -0.02."""
    ic = X._ics(spark, sf_dir).withColumn("block", F.ntile(3).over(Window.partitionBy("factor").orderBy("date")))
    blocks = ic.groupBy("factor", "block").agg(F.round(F.avg("ic"), 9).alias("mean"))
    out = blocks.groupBy("factor").agg(F.count_if(F.col("mean") >= 0).alias("positive_blocks"), F.round(F.min("mean"), 6).alias("worst_block"))
    return out.withColumn("passes", (F.col("positive_blocks") * 3 >= 6) & (F.col("worst_block") >= -0.02))


STABILITY_SQL = with_(*X.BASE, X.IC) + """SELECT factor, positive_blocks, worst_block, positive_blocks * 3 >= 6 AND worst_block >= -0.02 AS passes FROM (
  SELECT factor, count(*) FILTER (mean >= 0) AS positive_blocks, round(min(mean), 6) AS worst_block FROM (SELECT factor, block, round(avg(ic), 9) AS mean FROM (SELECT *, ntile(3) OVER (PARTITION BY factor ORDER BY date) AS block FROM ic) GROUP BY 1, 2) GROUP BY 1)"""


def coefficient_diversity(spark, sf_dir):
    """Correlation of coefficient paths for each pair of factors, and whether the later one is a copy (0.90 or more over 5 dates)."""
    ic = X._ics(spark, sf_dir).select("factor", "date", "ic")
    other = ic.select(F.col("factor").alias("other"), "date", F.col("ic").alias("ic2"))
    pairs = ic.join(other, "date").where("factor < other").groupBy("factor", "other")  # factors are few; dates meet by key
    m = pairs.agg(F.count(F.lit(1)).alias("dates"), F.covar_pop("ic", "ic2").alias("c"), (F.var_pop("ic") * F.var_pop("ic2")).alias("v"))
    return m.select("factor", "other", "dates", F.round(F.try_divide(F.col("c"), F.sqrt("v")), 6).alias("correlation"), (F.coalesce(F.abs(F.try_divide(F.col("c"), F.sqrt("v"))) >= 0.90, F.lit(False)) & (F.col("dates") >= 5)).alias("duplicate"))


DIVERSITY_SQL = with_(*X.BASE, X.IC) + """SELECT factor, other, dates, round(c / sqrt(v), 6) AS correlation, coalesce(abs(c / sqrt(v)) >= 0.90, false) AND dates >= 5 AS duplicate FROM (
  SELECT a.factor, z.factor AS other, count(*) AS dates, covar_pop(a.ic, z.ic) AS c, var_pop(a.ic) * var_pop(z.ic) AS v FROM ic a JOIN ic z ON a.date = z.date AND a.factor < z.factor GROUP BY 1, 2)"""

#: Rejection reason and the condition under which it is given.
GATES = [("SELECTION_IC_HISTORY_INSUFFICIENT", "dates < 3"), ("SELECTION_IC_BELOW_0_01", "ic_mean < 0.01"), ("SELECTION_IR_BELOW_0_10", "ic_ir < 0.10"), ("SELECTION_RECENT_IC_BELOW_0_005", "recent_mean < 0.005")]


def candidate_gates(spark, sf_dir):
    summary = X.ic_summary(spark, sf_dir)
    reasons = F.array_compact(F.array(*[F.when(F.expr(c), name) for name, c in GATES]))
    return summary.select("factor", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


GATES_SQL = with_(*X.BASE, X.IC, X.SUMMARY) + "SELECT factor, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in GATES) + ") AS reasons, NOT (" + " OR ".join(f"coalesce({c}, false)" for _, c in GATES) + ") AS accepted FROM su"

QUERIES = {f.__name__: f for f in (monthly_trend, weekly_trend, setup_and_risk, priority_score, blended_return, subperiod_stability, coefficient_diversity, candidate_gates)}
ORACLES = {
    "monthly_trend": with_(BARS, MONTHLY) + "SELECT * FROM mt",
    "weekly_trend": with_(BARS, WEEKLY) + "SELECT * FROM wt",
    "setup_and_risk": SETUP_SQL,
    "priority_score": PRIORITY_SQL,
    "blended_return": BLEND_SQL,
    "subperiod_stability": STABILITY_SQL,
    "coefficient_diversity": DIVERSITY_SQL,
    "candidate_gates": GATES_SQL,
}
