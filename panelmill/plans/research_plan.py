"""Factor metrics, holdouts, registries, live health, regimes, statuses and portfolio summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.functions import windows as W
from panelmill.operators import crosssection as S
from panelmill.operators import factors as R
from panelmill.operators import portfolio as P
from panelmill.operators import regime as G
from panelmill.operators import status as T
from panelmill.plans import crosssection_plan as X
from panelmill.plans import labels_plan as L
from panelmill.plans.sql import BENCH, with_

#: Horizon in sessions, and weeks of the panel.
AHEAD = [(5, 1), (10, 2), (20, 4)]
LAST = "OVER (PARTITION BY code ORDER BY date)"


def _ahead(spark, sf_dir):
    return X.panel(spark, sf_dir).withColumns({f"forward_{h}": F.round(F.lead("close", k).over(W.by_code()) / F.col("close") - 1, 9) for h, k in AHEAD})


def _neutral(spark, sf_dir):
    """One row for each factor of each row of the panel, with its neutral value."""
    rows = _ahead(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("value")) for c in X.FACTORS])).alias("f")
    long = rows.select("code", F.col("date").alias("day"), "industry_group", *[f"forward_{h}" for h, _ in AHEAD], each).select("*", "f.*").drop("f")
    # The rows of a factor on a date are a cross-section of their own.
    keyed = S.neutralised(long.withColumn("date", F.struct("day", "factor")), "value")
    return keyed.withColumn("date", F.col("day")).withColumn("neutral", F.round("neutral", 9)).drop("day")


def _ics(neutral):
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_{h}").alias("ahead")) for h, _ in AHEAD])).alias("h")
    long = neutral.select("date", "factor", "code", "neutral", each).select(F.struct("date", "factor", "h.horizon").alias("date"), "code", "neutral", "h.ahead")
    return S.rank_ic(long, "neutral", "ahead").select("date.factor", "date.horizon", "date.date", F.round("ic", 9).alias("ic"))


def factor_metrics(spark, sf_dir):
    neutral = _neutral(spark, sf_dir)
    dates = neutral.select("date").distinct().withColumn("recent", F.row_number().over(Window.orderBy(F.desc("date"))) <= 26)  # one row a date
    turnover = S.top_quartile_turnover(neutral, "neutral", by=["factor"]).groupBy("factor").agg(F.avg("turnover").alias("turnover"))
    return R.factor_metrics(_ics(neutral).join(dates, "date"), turnover)


NEUTRAL = "ah AS (SELECT *, " + ", ".join(f"round(lead(close, {k}) {LAST} / close - 1, 9) AS forward_{h}" for h, k in AHEAD) + """ FROM pan),
fa AS (""" + " UNION ALL ".join(f"SELECT code, date, industry_group, forward_5, forward_10, forward_20, '{c}' AS factor, {c} AS value FROM ah" for c in X.FACTORS) + """),
nd AS (SELECT *, value - CASE WHEN count(*) OVER (PARTITION BY factor, date, industry_group) >= 2 THEN avg(value) OVER (PARTITION BY factor, date, industry_group) ELSE avg(value) OVER (PARTITION BY factor, date) END AS d FROM fa),
ne AS (SELECT *, round((d - avg(d) OVER (PARTITION BY factor, date)) / greatest(stddev_pop(d) OVER (PARTITION BY factor, date), 1e-8), 9) AS neutral FROM nd),
ho AS (""" + " UNION ALL ".join(f"SELECT factor, date, {h} AS horizon, neutral AS x, forward_{h} AS y FROM ne WHERE forward_{h} IS NOT NULL" for h, _ in AHEAD) + """),
hr AS (SELECT factor, date, horizon, (rank() OVER (PARTITION BY factor, horizon, date ORDER BY x) + (count(*) OVER (PARTITION BY factor, horizon, date, x) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY factor, horizon, date) AS a,
  (rank() OVER (PARTITION BY factor, horizon, date ORDER BY y) + (count(*) OVER (PARTITION BY factor, horizon, date, y) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY factor, horizon, date) AS b FROM ho),
hi AS (SELECT factor, date, horizon, round(c / sqrt(va * vb), 9) AS ic FROM (SELECT factor, date, horizon, count(*) AS n, covar_pop(a, b) AS c, var_pop(a) AS va, var_pop(b) AS vb FROM hr GROUP BY 1, 2, 3) WHERE n >= 3 AND va > 1e-12 AND vb > 1e-12)"""
#: The normal tail by the series of the error function, the sign tail by binomial coefficients; neither is how the query computes them.
ERF = X.ERF
SIGN = "least(1, list_sum(list_transform(range(wins, nonzero + 1), lambda k: exp(lgamma(nonzero + 1) - lgamma(k + 1) - lgamma(nonzero - k + 1) - nonzero * ln(2)))))"
METRICS = f"""rd AS (SELECT date, row_number() OVER (ORDER BY date DESC) <= 26 AS recent FROM (SELECT DISTINCT date FROM pan)),
hq AS (SELECT factor, code, dense_rank() OVER (PARTITION BY factor ORDER BY date) AS t, row_number() OVER (PARTITION BY factor, date ORDER BY neutral DESC, code) AS rk, ceil(count(*) OVER (PARTITION BY factor, date) * 0.25) AS k FROM ne),
hw AS (SELECT factor, code, t, 1 / k AS w FROM hq WHERE rk <= k),
tn AS (SELECT factor, avg(tv) AS turnover FROM (SELECT factor, t, sum(abs(d)) / 2 AS tv FROM (SELECT factor, t, code, sum(w) AS d FROM (SELECT factor, code, t, w FROM hw UNION ALL SELECT factor, code, t + 1, -w FROM hw) GROUP BY 1, 2, 3) GROUP BY 1, 2)
  JOIN (SELECT DISTINCT factor, t FROM hq) USING (factor, t) WHERE t > 1 GROUP BY factor),
m0 AS (SELECT factor, count(*) FILTER (horizon = 10) AS observations, coalesce(avg(ic) FILTER (horizon = 10), 0) AS ic_mean, greatest(coalesce(stddev_samp(ic) FILTER (horizon = 10), 0), 1e-8) AS sd,
  coalesce(avg(ic) FILTER (horizon = 10 AND recent), 0) AS recent_mean, greatest(coalesce(stddev_samp(ic) FILTER (horizon = 10 AND recent), 0), 1e-8) AS recent_sd,
  count(*) FILTER (horizon = 10 AND abs(ic) > 1e-12) AS nonzero, count(*) FILTER (horizon = 10 AND ic > 1e-12) AS wins, {', '.join(f'coalesce(avg(ic) FILTER (horizon = {h}), 0) AS decay_{h}' for h, _ in AHEAD)} FROM hi JOIN rd USING (date) GROUP BY factor),
m1 AS (SELECT *, ic_mean / sd * sqrt(52) AS ic_ir, recent_mean / recent_sd * sqrt(52) AS recent_ir, ic_mean / sd * sqrt(observations) AS ic_t, abs(decay_20) / greatest(abs(decay_5), abs(decay_10), 0.01) AS decay_ratio, abs(ic_mean / sd * sqrt(observations)) / sqrt(2) AS x FROM m0 JOIN tn USING (factor)),
m2 AS (SELECT *, CASE WHEN ic_mean > 0 THEN greatest({SIGN}, 1 - ({ERF})) ELSE 1 END AS p, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in R.REASONS)}], lambda r: r IS NOT NULL) AS why FROM m1),
fm AS (SELECT factor, observations, round(ic_mean, 6) AS ic_mean, round(ic_ir, 5) AS ic_ir, round(ic_t, 5) AS ic_t, round(wins / greatest(nonzero, 1), 6) AS positive, round(p, 6) AS p, round(recent_mean, 6) AS recent_mean, round(recent_ir, 5) AS recent_ir,
  {', '.join(f'round(decay_{h}, 6) AS decay_{h}' for h, _ in AHEAD)}, round(decay_ratio, 5) AS decay_ratio, round(turnover, 6) AS turnover, array_to_string(why, ',') AS reasons,
  CASE WHEN len(why) = 0 THEN 'ACTIVE' WHEN len(why) <= 2 AND NOT list_has_any(why, [{', '.join(repr(h) for h in R.HARD)}]) THEN 'WATCH' ELSE 'RETIRED' END AS status FROM m2)"""


def rejection_counts(spark, sf_dir):
    """How many factors have each status and each reason."""
    found = factor_metrics(spark, sf_dir)
    each = found.select(F.explode(F.concat(F.array(F.concat(F.lit("status:"), F.col("status"))), F.filter(F.split("reasons", ","), lambda x: x != ""))).alias("name"))
    return each.groupBy("name").agg(F.count(F.lit(1)).alias("factors"))


def purged_holdout(spark, sf_dir):
    parts = R.purged_holdout(X.panel(spark, sf_dir).select("date", "code"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


HOLDOUT_SQL = with_(*X.BASE) + """, dk AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM pan)),
cu AS (SELECT max(date) FILTER (k <= greatest(floor(n * 0.70::DOUBLE), 1)) AS a, max(date) FILTER (k <= greatest(floor(n * 0.85::DOUBLE), 1)) AS b FROM dk)
SELECT part, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM (SELECT date, CASE WHEN date <= a THEN 'train' WHEN date > a + 28 AND date <= b THEN 'selection' WHEN date > b + 28 THEN 'approval' END AS part FROM pan, cu) GROUP BY 1""".replace("\n, dk", ", dk")

REGISTRY = [("momentum_20", 0.5), ("trend_efficiency_20", 0.3), ("volume_confirmation", 0.2)]


def registry_scores(spark, sf_dir):
    return R.apply_registry(X.panel(spark, sf_dir), REGISTRY).select("date", "code", F.round(F.col("ensemble") + 1e-10, 6).alias("ensemble"), F.round("adaptive", 6).alias("adaptive"))


def _less_group(c, name):
    return f"{c} - CASE WHEN count(*) OVER (PARTITION BY date, industry_group) >= 2 THEN avg({c}) OVER (PARTITION BY date, industry_group) ELSE avg({c}) OVER (PARTITION BY date) END AS {name}"


def _unit(c):
    return f"round(({c} - avg({c}) OVER (PARTITION BY date)) / greatest(stddev_pop({c}) OVER (PARTITION BY date), 1e-8), 9)"


REGISTRY_SQL = with_(*X.BASE) + ", r0 AS (SELECT code, date, industry_group, " + ", ".join(_less_group(c, f"d{i}") for i, (c, _) in enumerate(REGISTRY)) + " FROM pan), r1 AS (SELECT code, date, industry_group, " + ", ".join(f"{_unit(f'd{i}')} AS z{i}" for i in range(len(REGISTRY))) + " FROM r0), r2 AS (SELECT code, date, industry_group, round(" + " + ".join(f"z{i} * {w!r}::DOUBLE" for i, (_, w) in enumerate(REGISTRY)) + f" + 1e-11, 9) AS ensemble FROM r1), r3 AS (SELECT *, {_less_group('ensemble', 'd')} FROM r2), r4 AS (SELECT *, {_unit('d')} AS neutral FROM r3) SELECT date, code, round(ensemble + 1e-10, 6) AS ensemble, round({X._pct('neutral')} * 100, 6) AS adaptive FROM r4"

CUT_OFF = "1996-06-30"


def live_factor_health(spark, sf_dir):
    """Coefficients at horizon 10 on every second date after the training cut-off, and the verdict of each factor."""
    ics = _ics(_neutral(spark, sf_dir)).where((F.col("horizon") == 10) & (F.col("date") > F.lit(CUT_OFF).cast("date")))
    ics = ics.withColumn("k", F.dense_rank().over(Window.partitionBy("factor").orderBy("date"))).where("k % 2 = 1")
    found = ics.groupBy("factor").agg(F.count("ic").alias("observations"), F.avg("ic").alias("ic_mean"), (F.avg("ic") / F.greatest(F.stddev_samp("ic"), F.lit(1e-8)) * F.sqrt(F.lit(52.0))).alias("ic_ir"))
    return R.live_verdict(found).select("factor", "observations", F.round("ic_mean", 6).alias("ic_mean"), F.round("ic_ir", 5).alias("ic_ir"), "decision")


HEALTH_SQL = with_(*X.BASE, NEUTRAL) + f"""SELECT factor, observations, round(ic_mean, 6) AS ic_mean, round(ic_ir, 5) AS ic_ir, CASE WHEN observations < 8 THEN 'WARMUP' WHEN ic_mean <= -0.03 AND ic_ir <= -0.25 THEN 'SUSPENDED' WHEN ic_mean >= 0.01 AND ic_ir >= 0.15 THEN 'ACTIVE' ELSE 'WATCH' END AS decision FROM (
  SELECT factor, count(ic) AS observations, avg(ic) AS ic_mean, avg(ic) / greatest(stddev_samp(ic), 1e-8) * sqrt(52) AS ic_ir FROM (SELECT *, dense_rank() OVER (PARTITION BY factor ORDER BY date) AS k FROM hi WHERE horizon = 10 AND date > DATE '{CUT_OFF}') WHERE k % 2 = 1 GROUP BY 1)"""


def spearman_by_code(spark, sf_dir):
    """Rank correlation of momentum and what follows, over the weeks of each instrument."""
    rows = X.panel(spark, sf_dir).where("forward IS NOT NULL").select("code", W.percentile_rank("momentum_20", "code").alias("a"), W.percentile_rank("forward", "code").alias("b"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("weeks"), F.round(F.corr("a", "b"), 6).alias("spearman"))


def _rank_of(c):
    return f"(rank() OVER (PARTITION BY code ORDER BY {c}) + (count(*) OVER (PARTITION BY code, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY code)"


SPEARMAN_SQL = with_(*X.BASE) + f"SELECT code, count(*) AS weeks, round(corr(a, b), 6) AS spearman FROM (SELECT code, {_rank_of('momentum_20')} AS a, {_rank_of('forward')} AS b FROM pan WHERE forward IS NOT NULL) GROUP BY 1"


def portfolio_summary(spark, sf_dir):
    return P.summary(L._monthly(spark, sf_dir).select("code", "date", (F.col("r") / 1000).alias("r"), (F.col("rb") / 1000).alias("rb")))


SUMMARY = """ps AS (SELECT code, date, r / 1000 AS r, rb / 1000 AS rb, exp(sum(ln(1 + r / 1000)) OVER w) AS nav, exp(sum(ln(1 + rb / 1000)) OVER w) AS bnav FROM wr WINDOW w AS (PARTITION BY code ORDER BY date)),
pd AS (SELECT *, 1 - nav / greatest(1, max(nav) OVER w) AS dd, 1 - bnav / greatest(1, max(bnav) OVER w) AS bdd FROM ps WINDOW w AS (PARTITION BY code ORDER BY date)),
py AS (SELECT code, avg(CASE WHEN e > 0 THEN 1.0::DOUBLE ELSE 0 END) AS py FROM (SELECT code, year(date) AS y, round(product(1 + r) - product(1 + rb), 9) AS e FROM ps GROUP BY 1, 2) GROUP BY 1),
pa AS (SELECT code, count(*) AS periods, arg_max(nav, date) - 1 AS total, arg_max(bnav, date) - 1 AS btotal, greatest(date_diff('day', min(date), max(date)) / 365.25::DOUBLE, 1 / 52::DOUBLE) AS years, avg(r - rb) / greatest(stddev_samp(r - rb), 1e-8) * sqrt(52) AS ir, avg(r) / greatest(stddev_samp(r), 1e-8) * sqrt(52) AS sharpe, max(dd) AS dd, max(bdd) AS bdd FROM pd GROUP BY 1),
pf AS (SELECT code, periods, round(total, 6) AS total_return, round(power(1 + total, 1 / years) - 1, 6) AS cagr, round(btotal, 6) AS benchmark_return, round(total - btotal, 6) AS excess_return, round(ir, 5) AS information_ratio, round(sharpe, 5) AS sharpe, round(dd, 6) AS max_drawdown, round(bdd, 6) AS benchmark_drawdown, round(py, 6) AS positive_years FROM pa JOIN py USING (code))"""


def acceptance_gates(spark, sf_dir):
    found = portfolio_summary(spark, sf_dir)
    return found.select("code", F.array_join(R.reasons(P.GATES), ",").alias("failed"), (F.size(R.reasons(P.GATES)) == 0).alias("approved"))


GATES_SQL = with_(*X.BASE, BENCH, L.WEEKLY, SUMMARY) + "SELECT code, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in P.GATES) + ") AS failed, NOT (" + " OR ".join(f"coalesce({c}, false)" for _, c in P.GATES) + ") AS approved FROM pf"

DEFENSIVE = ["g0", "g1"]


def _regimes(spark, sf_dir):
    """The panel with the policy of each week. Among instruments of one date, momentum ranks as the excess over one benchmark does."""
    policy = X.market_policy(spark, sf_dir).select("date", F.col("state").alias("market_state"), F.col("score").alias("market_score"))
    rows = X.panel(spark, sf_dir).join(policy, "date").withColumns({"relative_strength": F.col("momentum_60"), "weekly_trend": F.col("trend_efficiency_20"), "priority": F.col("liquidity_log"), "amount": F.round(F.exp("liquidity_log"), 6)})
    rows = rows.withColumn("broad_amount", F.max("amount").over(S.by_date()))
    return G.regime_scores(rows)


def rotation_regimes(spark, sf_dir):
    return _regimes(spark, sf_dir).select("date", "code", "recovery", F.round("rotation_score", 6).alias("rotation_score"))


def rotation_targets(spark, sf_dir):
    rows = _regimes(spark, sf_dir)
    return G.select_targets(rows, DEFENSIVE, 3, LEAST_AMOUNT).withColumn("rotation_score", F.round("rotation_score", 6))


LEAST_AMOUNT = 30000.0
_POLICY = X.market_policy_sql()
_MIX = lambda weights: " + ".join(f"{w!r}::DOUBLE * {X._pct(c)}" for c, w in weights.items())
_STARTS = lambda *names: "(" + " OR ".join(f"starts_with(market_state, '{n}')" for n in names) + ")"
REGIMES = _POLICY[: _POLICY.rindex("SELECT date, bull")].rstrip() + f""",
q0 AS (SELECT pan.*, state AS market_state, score AS market_score, momentum_60 AS relative_strength, trend_efficiency_20 AS weekly_trend, liquidity_log AS priority, round(exp(liquidity_log), 6) AS amount FROM pan JOIN policy USING (date)),
q1 AS (SELECT *, {_STARTS('PULSE_FULL', 'PULSE_EARLY')} OR market_score >= 0 AS recovery, max(amount) OVER (PARTITION BY date) AS broad FROM q0),
q2 AS (SELECT *, round(CASE WHEN recovery THEN {_MIX(G.RECOVERY_WEIGHTS)} ELSE {_MIX(G.DEFENSIVE_WEIGHTS)} END, 9) AS rotation_score FROM q1)"""
_PURE = "industry_group IN ('g0', 'g1')"
TARGETS = f""",
q3 AS (SELECT *, CASE WHEN market_state IN ('DEFENSIVE', 'HARD_DEFENSIVE', 'RISK_OFF') OR {_STARTS('PULSE_HARD')} THEN 0.0 ELSE -0.1 END AS base FROM q2),
q4 AS (SELECT *, CASE WHEN NOT recovery THEN base WHEN {_STARTS('PULSE_EARLY')} THEN least(base, -0.15) WHEN market_state = 'PULSE_HARD' THEN greatest(base, 0.0) ELSE greatest(base, 0.05) END AS trend_floor FROM q3),
q5 AS (SELECT * FROM q4 WHERE weekly_trend >= trend_floor AND amount >= {LEAST_AMOUNT} AND (NOT recovery OR (momentum_20 >= 0 AND (NOT {_PURE} OR (NOT {_STARTS('PULSE')} AND momentum_20 > 0))))),
q6 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rotation_score DESC, code) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY date, industry_group ORDER BY rotation_score DESC, code) AS g FROM q5) WHERE g = 1),
q7 AS (SELECT *, {_PURE} AS pure FROM q6 WHERE slot <= 3),
q8 AS (SELECT d.date, recovery, broad, coalesce(names, 0) AS names, coalesce(risk, 0) AS risk, weakest, coalesce(broad_held, false) AS broad_held FROM (SELECT date, bool_or(recovery) AS recovery, max(broad) AS broad FROM q2 GROUP BY 1) d LEFT JOIN (SELECT date, count(*) AS names, count(*) FILTER (NOT pure) AS risk, max(slot) FILTER (pure) AS weakest, bool_or(industry_group = 'broad_market') AS broad_held FROM q7 GROUP BY 1) USING (date)),
q9 AS (SELECT date, risk = 0 AS alone, CASE WHEN risk = 0 THEN 1 WHEN names < 3 THEN names + 1 ELSE coalesce(weakest, names) END AS place FROM q8 WHERE recovery AND risk < 2 AND NOT broad_held AND broad >= {LEAST_AMOUNT})
SELECT date, CAST(slot AS INT) AS slot, code, industry_group, round(rotation_score, 6) AS rotation_score FROM q7 LEFT JOIN q9 USING (date) WHERE place IS NULL OR (NOT alone AND slot <> place)
UNION ALL SELECT date, CAST(place AS INT), 'BROAD', 'broad_market', 0.5::DOUBLE FROM q9"""


def publication_order(spark, sf_dir):
    """The ten best and the five worst names of the last week."""
    scored = _regimes(spark, sf_dir)
    last = scored.join(scored.agg(F.max("date").alias("date")), "date").select("code", "rotation_score")
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    best = last.orderBy(F.desc("rotation_score"), "code").limit(10).select(F.lit("TOP").alias("kind"), place(F.desc("rotation_score"), "code").alias("place"), "code")
    worst = last.orderBy("rotation_score", "code").limit(5).select(F.lit("BOTTOM").alias("kind"), place("rotation_score", "code").alias("place"), "code")
    return best.unionByName(worst)


ORDER_SQL = REGIMES + """, lw AS (SELECT code, rotation_score FROM q2 WHERE date = (SELECT max(date) FROM q2))
SELECT 'TOP' AS kind, CAST(k AS INT) AS place, code FROM (SELECT code, row_number() OVER (ORDER BY rotation_score DESC, code) AS k FROM lw) WHERE k <= 10
UNION ALL SELECT 'BOTTOM', CAST(k AS INT), code FROM (SELECT code, row_number() OVER (ORDER BY rotation_score, code) AS k FROM lw) WHERE k <= 5"""


def _statuses(spark, sf_dir):
    five = lambda c, k: F.round(W.clip(F.col(c) * k, -5, 5), 2)
    rows = X.panel(spark, sf_dir).select("code", "date", five("momentum_60", 10).alias("m"), five("trend_efficiency_20", 10).alias("w"), five("reversal_5", 20).alias("d"), (F.col("volume_confirmation") > 0).alias("discounted"))
    return T.score_status(rows)


def status_scores(spark, sf_dir):
    return _statuses(spark, sf_dir).select("code", "date", "strength", "bonus", "penalty", "tags", "total", "status")


def _status_ctes():
    ramp = lambda e, a, b: f"greatest(0, least(1, (({e}) - {a}) / ({b} - {a})::DOUBLE))"
    lowest = "least(m, w, d)"
    holds = [f"{lowest} > 0 AND m >= {a} AND w >= {b} AND d >= {c} AND {lowest} >= {e}" for _, a, b, c, e, _, _ in T.STRENGTHS]
    name = "CASE " + " ".join(f"WHEN {h} THEN '{s[0]}'" for h, s in zip(holds, T.STRENGTHS, strict=True)) + " ELSE '' END"
    bonus = "CASE " + " ".join(f"WHEN {h} THEN least({s[6]}::DOUBLE, {lowest} * {T.RESONANCE}::DOUBLE * {s[5]}::DOUBLE)" for h, s in zip(holds, T.STRENGTHS, strict=True)) + " ELSE 0 END"
    parts, tags = [], []
    for tag, when, (a, a0, a1), (b, b0, b1), share, other, weight in T.CONFLICTS:
        part = f"greatest(0.2, least(1, {ramp(a, a0, a1)} * {share}::DOUBLE + {ramp(b, b0, b1)} * {other}::DOUBLE)) * {T.DIVERGENCE * weight!r}::DOUBLE"
        half = f" * CASE WHEN discounted THEN 0.5 ELSE 1 END" if tag in T.HALVED else ""
        parts.append(f"CASE WHEN {when} THEN {part}{half} ELSE 0 END")
        tags.append(f"CASE WHEN {when} THEN '{tag}' END")
    five = lambda c, k: f"round(greatest(-5, least(5, {c} * {k})), 2)"
    bucket = "CASE " + " ".join(f"WHEN total >= {e} THEN '{n}' WHEN total <= -{e} THEN '{n.replace('BULL', 'BEAR')}'" for n, e in T.BUCKETS) + " ELSE 'NEUTRAL' END"
    return f"""s0 AS (SELECT code, date, {five('momentum_60', 10)} AS m, {five('trend_efficiency_20', 10)} AS w, {five('reversal_5', 20)} AS d, volume_confirmation > 0 AS discounted FROM pan),
s1 AS (SELECT *, {name} AS strength, round({bonus}, 6) AS bonus, round({' + '.join(parts)}, 6) AS penalty, concat_ws(',', {', '.join(tags)}) AS tags FROM s0),
s2 AS (SELECT *, round(m + w + d + bonus + penalty + 1e-7, 1) AS total FROM s1),
s3 AS (SELECT *, {bucket} AS status FROM s2)"""


def _levels(df):
    level = F.when(F.col("total") >= 7, 4).when(F.col("total") >= 2.5, 3).when(F.col("total") <= -7, 0).when(F.col("total") <= -2.5, 1).otherwise(2)
    return df.select(F.col("code").alias("key"), F.col("date").alias("day"), level.alias("status"), F.col("total").alias("score"))


def change_signals(spark, sf_dir):
    return T.change_signal(_levels(_statuses(spark, sf_dir)))


CHANGE_SQL = with_(*X.BASE, _status_ctes()) + """, s4 AS (SELECT code AS key, date AS day, CASE WHEN total >= 7 THEN 4 WHEN total >= 2.5 THEN 3 WHEN total <= -7 THEN 0 WHEN total <= -2.5 THEN 1 ELSE 2 END AS level, total FROM s3),
s5 AS (SELECT *, lag(level) OVER w AS was, lag(total) OVER w AS before, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS k FROM s4 WINDOW w AS (PARTITION BY key ORDER BY day))
SELECT key, level <> was AS status_changed, level >= 3 AND was < 3 AS turned_up, level <= 1 AND was > 1 AS turned_down, abs(total - before) > 2.0 AS accelerating FROM s5 WHERE k = 1 AND was IS NOT NULL""".replace("\n, s4", ", s4")

QUERIES = {f.__name__: f for f in (factor_metrics, rejection_counts, purged_holdout, registry_scores, live_factor_health, spearman_by_code, portfolio_summary, acceptance_gates, rotation_regimes, rotation_targets, publication_order, status_scores, change_signals)}
ORACLES = {
    "factor_metrics": with_(*X.BASE, NEUTRAL, METRICS) + "SELECT * FROM fm",
    "rejection_counts": with_(*X.BASE, NEUTRAL, METRICS) + "SELECT name, count(*) AS factors FROM (SELECT 'status:' || status AS name FROM fm UNION ALL SELECT unnest(why) FROM m2) GROUP BY 1",
    "purged_holdout": HOLDOUT_SQL,
    "registry_scores": REGISTRY_SQL,
    "live_factor_health": HEALTH_SQL,
    "spearman_by_code": SPEARMAN_SQL,
    "portfolio_summary": with_(*X.BASE, BENCH, L.WEEKLY, SUMMARY) + "SELECT * FROM pf",
    "acceptance_gates": GATES_SQL,
    "rotation_regimes": REGIMES + " SELECT date, code, recovery, round(rotation_score, 6) AS rotation_score FROM q2",
    "rotation_targets": REGIMES + TARGETS,
    "publication_order": ORDER_SQL,
    "status_scores": with_(*X.BASE, _status_ctes()) + "SELECT code, date, strength, bonus, penalty, tags, total, status FROM s3",
    "change_signals": CHANGE_SQL,
}
