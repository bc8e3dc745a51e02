"""The calibration panel: features, market, setup and labels of every instrument at every signal date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators import calibration as K
from panelmill.operators import governance as G
from panelmill.operators import panel as P
from panelmill.operators import policy
from panelmill.operators import signals as S
from panelmill.plans import bars_plan as D
from panelmill.plans import crosssection_plan as X
from panelmill.plans import labels_plan as L
from panelmill.plans.factors_plan import _unit
from panelmill.plans.indicators_plan import PRIM, PRIMITIVES, TR, over, primitives
from panelmill.plans.sql import BARS, BENCH, with_
from panelmill.sources import bars as B
from panelmill.sources import cuts

TEXTS = ["code", "market_state", "permission", "setup"]
DATES = ["signal_date", "bar_date"]
LABELS = ["early_stop", "win_10d", "excess_5d", "excess_10d", "excess_20d"]
NUMBERS = [*P.LEAVES, "weekly_preview", "monthly_preview", "max_exposure", "setup_raw", "priority", *LABELS[2:]]
FLAGS = ["executable", "baseline", "early_stop", "win_10d"]


@cuts.sharing
def panel(spark, sf_dir) -> DataFrame:
    """The panel unrounded; its bars, benchmark and labels come from the tables, whose trades are read for the bars alone."""
    bars, bench = B.daily_bars(spark, sf_dir), B.benchmark(spark, sf_dir)
    labels = L.forward_labels(spark, sf_dir).select("code", "date", "early_stop", (F.col("return_10d") > 0).cast("int").alias("win_10d"), *LABELS[2:])
    features = primitives(spark, sf_dir).select("code", "date", *PRIMITIVES)
    crossed = D.adjustment_crossed(spark, sf_dir).where("crossed").select("code", "date")
    return P.calibration_panel(bars, bench.select("date", F.col("bench").alias("close")), features, labels, crossed)


def calibration_panel(spark, sf_dir):
    """14 features, the market's state, setup, risk, priority, baseline flag and labels of every instrument at every fifth session."""
    return panel(spark, sf_dir).select(*TEXTS, *DATES, *[F.round(c, 6).alias(c) for c in NUMBERS], *FLAGS)


def _periods(unit: str, name: str, states: dict[str, tuple[str, int]], wide: str) -> str:
    """Periods with their states, and scores so far at every bar. wide: the score from close, mean, e3 or e4 and so on."""
    first = ", ".join(c for c, _ in states.values())
    step = ", ".join(f"r.{k} * (1 - {a}::DOUBLE / {d}) + b.{c} * ({a}::DOUBLE / {d})" for k, (c, (a, d)) in states.items())
    lags = ", ".join(f"lag({k}, {n}) OVER w AS {k}{n}" for k in states for n in (1, 3, 4))
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS p FROM (SELECT code, date_trunc('{unit}', date)::DATE AS date, max(high) AS high, min(low) AS low, arg_max(close, date) AS close FROM xb GROUP BY 1, 2)),
{name}1 AS (SELECT *, {TR} AS tr, abs(close - lag(close) OVER (PARTITION BY code ORDER BY date)) AS step FROM {name}0),
{name}f(code, p, {', '.join(states)}) AS (SELECT code, p, {first} FROM {name}1 WHERE p = 1 UNION ALL SELECT b.code, b.p, {step} FROM {name}f r JOIN {name}1 b ON b.code = r.code AND b.p = r.p + 1),
{name}b AS (SELECT code, date AS period, p, {lags}, lag(close) OVER w AS close1, lag(close, 13) OVER w AS close13, sum(step) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS path12 FROM {name}1 JOIN {name}f USING (code, p) WINDOW w AS (PARTITION BY code ORDER BY date)),
{name}d AS (SELECT code, date, date_trunc('{unit}', date)::DATE AS period, close, max(high) OVER v AS top, min(low) OVER v AS bottom FROM xb WINDOW v AS (PARTITION BY code, date_trunc('{unit}', date) ORDER BY date)),
{name}s AS (SELECT code, date, period, {wide} AS score FROM {name}x),
{name}c AS (SELECT code, stop AS date, arg_max(score, date) AS score FROM {name}s JOIN (SELECT date_trunc('{unit}', date)::DATE AS period, max(date) AS stop FROM bm GROUP BY 1) USING (period) GROUP BY code, stop)"""


WEEKS = _periods("week", "w", {"e": ("close", (2, 21)), "a": ("tr", (1, 14))}, """CASE WHEN p >= 21 AND least(close, atr, mean, e4) > 0 THEN round(greatest(-1, least(1,
  0.40::DOUBLE * tanh((close - mean) / atr / 2) + 0.35::DOUBLE * tanh(ln(mean / e4) / (4 * greatest(atr / close, 0.005))) + 0.25::DOUBLE * CASE WHEN path > 0 THEN greatest(-1, least(1, (close - close13) / path)) ELSE 0 END)), 6) ELSE 0 END""").replace(
    "\nws AS", """
wx AS (SELECT *, e1 * (1 - 2::DOUBLE / 21) + close * (2::DOUBLE / 21) AS mean, a1 * (1 - 1::DOUBLE / 14) + greatest(top - bottom, abs(top - close1), abs(bottom - close1)) * (1::DOUBLE / 14) AS atr, path12 + abs(close - close1) AS path FROM wd JOIN wb USING (code, period)),
ws AS""")  # fmt: skip
MONTHS = _periods("month", "m", {"e": ("close", (2, 11))}, """CASE WHEN p >= 13 AND least(close, mean, e3) > 0 THEN round(greatest(-1, least(1, 0.55::DOUBLE * tanh(ln(close / mean) / 0.08) + 0.45::DOUBLE * tanh(ln(mean / e3) / 0.06))), 6) ELSE 0 END""").replace(
    "\nms AS", """
mx AS (SELECT *, e1 * (1 - 2::DOUBLE / 11) + close * (2::DOUBLE / 11) AS mean FROM md JOIN mb USING (code, period)),
ms AS""")  # fmt: skip

_RAW = X.ORACLES["relative_strength"]
STRENGTH = _RAW[_RAW.index("j AS ("): _RAW.index("l AS (")].rstrip().rstrip(",")
_COLUMNS = _RAW[_RAW.index("FROM (SELECT *, ") + len("FROM (SELECT *, "): _RAW.index(" FROM be)")]
_cut = ", ".join(f"greatest(quantile_cont(raw{n}, 0.05) OVER (PARTITION BY signal_date), least(quantile_cont(raw{n}, 0.95) OVER (PARTITION BY signal_date), raw{n})) AS c{n}" for n in (20, 60, 120))
_pct = ", ".join(f"CASE WHEN raw{n} IS NOT NULL THEN (rank() OVER (PARTITION BY signal_date, raw{n} IS NULL ORDER BY c{n}) + (count(*) OVER (PARTITION BY signal_date, raw{n} IS NULL, c{n}) - 1) / 2.0::DOUBLE) / count(raw{n}) OVER (PARTITION BY signal_date) * 100 END AS p{n}" for n in (20, 60, 120))
_parts = {20: 0.5, 60: 0.3, 120: 0.2}
_score = "round(greatest(0, least(100, coalesce((" + " + ".join(f"coalesce(p{n}, 0) * {w}" for n, w in _parts.items()) + ") / nullif(" + " + ".join(f"CASE WHEN p{n} IS NULL THEN 0 ELSE {w} END" for n, w in _parts.items()) + ", 0), 0))), 3)"

PANEL_CTES = f"""xb AS (SELECT code, date, high, low, close FROM bars UNION ALL SELECT '*', date, bench, bench, bench FROM bm),
{WEEKS},
{MONTHS},
{STRENGTH},
rs AS (SELECT code, date, raw20, raw60, raw120 FROM (SELECT *, {_COLUMNS} FROM be)),
ses AS (SELECT date, k, (k - 1 >= {P.WARM_UP} AND k - 1 < z - {P.HORIZON} AND (k - 1 - {P.WARM_UP}) % {P.STEP} = 0) AS signal FROM (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS z FROM bm)),
d0 AS (SELECT *, {TR} AS tr, count(*) OVER (PARTITION BY code) AS m, lag(close) OVER (PARTITION BY code ORDER BY date) AS previous, max(high) {over(20, 1)} AS high20, min(low) {over(10, 1)} AS swing, avg(volume) {over(20, 1)} AS vma FROM b),
df(code, n, a5, a14, a20, e) AS (SELECT code, n, tr, tr, tr, close FROM d0 WHERE n = 1 UNION ALL SELECT b.code, b.n, {', '.join(f'r.a{k} * (1 - 1::DOUBLE / {k}) + b.tr * (1::DOUBLE / {k})' for k in (5, 14, 20))}, r.e * (1 - 2::DOUBLE / 21) + b.close * (2::DOUBLE / 21)
  FROM df r JOIN d0 b ON b.code = r.code AND b.n = r.n + 1),
dk AS (SELECT d0.*, a5, a14, a20, e, {_unit('(close - low) / greatest(high - low, close * 1e-6)')} AS clv, CASE WHEN vma > 0 THEN volume / vma ELSE 1 END AS vr, (close - high20) / a14 AS gap, (close - e) / a14 AS dist, k, coalesce(lead(k) OVER (PARTITION BY code ORDER BY date) - 1, k) AS until FROM d0 JOIN df USING (code, n) JOIN ses USING (date)),
at0 AS (SELECT dk.*, dk.date AS bar_date, s.date AS signal_date FROM dk JOIN ses s ON s.signal AND s.k BETWEEN dk.k AND dk.until WHERE n >= {P.WARM_UP} AND m - n >= {P.HORIZON}),
at1 AS (SELECT at0.*, coalesce(wc.score, 0) AS weekly_score FROM at0 ASOF LEFT JOIN wc ON wc.code = at0.code AND wc.date <= at0.signal_date),
at2 AS (SELECT at1.*, coalesce(mc.score, 0) AS monthly_score FROM at1 ASOF LEFT JOIN mc ON mc.code = at1.code AND mc.date <= at1.signal_date),
at3 AS (SELECT at2.*, ws.score AS weekly_preview, ms.score AS monthly_preview, raw20, raw60, raw120 FROM at2 JOIN ws ON ws.code = at2.code AND ws.date = bar_date JOIN ms ON ms.code = at2.code AND ms.date = bar_date LEFT JOIN rs ON rs.code = at2.code AND rs.date = bar_date),
at4 AS (SELECT *, {_cut} FROM at3), at5 AS (SELECT *, {_pct} FROM at4), at6 AS (SELECT *, round({_score}, 2) AS rps FROM at5),
sb AS (SELECT *, CASE WHEN weekly_score >= 0.25 AND close >= high20 AND gap BETWEEN 0 AND 1 AND clv >= 0.65 AND vr >= 1.2 THEN 100 * (0.30::DOUBLE * {_unit('1 - abs(gap - 0.25) / 0.75')} + 0.25::DOUBLE * {_unit('ln(greatest(vr, 1)) / ln(2)')} + 0.25::DOUBLE * {_unit('(clv - 0.5) / 0.5')} + 0.20::DOUBLE * {_unit('1 - a5 / greatest(a20, 1e-9)')}) ELSE 0 END AS bs,
  CASE WHEN weekly_score >= 0.25 AND dist BETWEEN -0.75 AND 1.25 AND close > previous AND close >= open AND clv >= 0.55 AND vr <= 1.2 THEN 100 * (0.35::DOUBLE * {_unit('1 - abs(dist) / 1.5')} + 0.25::DOUBLE * {_unit('(clv - 0.5) / 0.5')} + 0.20::DOUBLE * {_unit('(1.2 - vr) / 0.7')} + 0.20::DOUBLE * {_unit('(close - previous) / a14')}) ELSE 0 END AS ps FROM at6),
ss AS (SELECT *, CASE WHEN bs >= ps AND bs > 0 THEN 'BREAKOUT' WHEN ps > 0 THEN 'PULLBACK' ELSE 'NONE' END AS setup, round(greatest(bs, ps), 4) AS setup_score FROM sb),
sk AS (SELECT *, least(CASE WHEN setup = 'BREAKOUT' THEN greatest(high20 - a14, swing - 0.25 * a14) ELSE swing - 0.25 * a14 END, close - 1.2 * a14) AS stop FROM ss),
sr AS (SELECT *, (close - stop) / close * 100 AS pct, (close - stop) / a14 AS mult FROM sk),
sx AS (SELECT *, stop > 0 AND stop < close AND pct BETWEEN 2 AND 10 AS executable FROM sr),
sq AS (SELECT *, round(CASE WHEN executable THEN 100 * (0.55::DOUBLE * {_unit('1 - abs(mult - 2.2) / 1.8')} + 0.45::DOUBLE * {_unit('1 - abs(pct - 5.5) / 4.5')}) ELSE 0 END, 4) AS risk_quality FROM sx),
sp AS (SELECT *, round(greatest(0, least(100, setup_score * 0.30::DOUBLE + rps * 0.30::DOUBLE + (weekly_score + 1) * 50 * 0.25::DOUBLE + risk_quality * 0.10::DOUBLE + (monthly_score + 1) * 50 * 0.05::DOUBLE + 1e-7)), 4) AS priority FROM sq),
q0 AS (SELECT date, bench, row_number() OVER (ORDER BY date) AS k, coalesce(abs(bench - lag(bench) OVER (ORDER BY date)), 0) AS tr, {', '.join(f'coalesce(round(bench / lag(bench, {k}) OVER (ORDER BY date) - 1, 9), 0) AS ret_{k}' for k in (1, 3, 5, 10))} FROM bm),
qf(k, a) AS (SELECT k, tr FROM q0 WHERE k = 1 UNION ALL SELECT b.k, r.a * (1 - 1::DOUBLE / 14) + b.tr * (1::DOUBLE / 14) FROM qf r JOIN q0 b ON b.k = r.k + 1),
q1 AS (SELECT *, list(CASE WHEN k >= 14 THEN natr END) OVER (ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS raw_past FROM (SELECT q0.*, round(a / bench, 9) AS natr FROM q0 JOIN qf USING (k))),
q2 AS (SELECT * EXCLUDE (raw_past), list_filter(raw_past, lambda x: x IS NOT NULL) AS past FROM q1),
q3 AS (SELECT * EXCLUDE (past), round(CASE WHEN k < 30 OR len(past) < 20 THEN 50 ELSE len(list_filter(past, lambda x: x < natr))::DOUBLE / len(past) * 100 END, 6) AS stress FROM q2),
q4 AS (SELECT q3.*, coalesce(wc.score, 0) AS trend FROM (SELECT *, '*' AS code FROM q3) q3 ASOF LEFT JOIN wc ON wc.code = q3.code AND wc.date <= q3.date),
q5 AS (SELECT * FROM q4 JOIN (SELECT signal_date AS date, count(*) AS total, count(*) FILTER (weekly_score >= 0.25) AS bull, count(*) FILTER (weekly_score <= -0.25) AS bear FROM sp GROUP BY 1) USING (date)),
{policy.policy_sql('q5').rstrip()},
cr AS (SELECT code, date AS bar_date, crossed FROM ({D.ORACLES['adjustment_crossed']})),
fl AS (SELECT code, date AS bar_date, early_stop, CAST(return_10d > 0 AS INT) AS win_10d, excess_5d, excess_10d, excess_20d FROM ({L.ORACLES['forward_labels']})),
pr9 AS (SELECT code, date AS bar_date, {', '.join(PRIMITIVES)} FROM pr),
cp AS (SELECT sp.code, sp.signal_date, sp.bar_date, setup, setup_score, setup_score AS setup_raw, executable, weekly_score, monthly_score, weekly_preview, monthly_preview, rps, risk_quality, priority, round(policy.score, 6) AS market_score, policy.state AS market_state, policy.permission, policy.exposure AS max_exposure,
  {S.BASELINE} AS baseline, {', '.join(PRIMITIVES)}, {', '.join(LABELS)}
  FROM sp JOIN policy ON policy.date = sp.signal_date JOIN pr9 ON pr9.code = sp.code AND pr9.bar_date = sp.bar_date JOIN fl ON fl.code = sp.code AND fl.bar_date = sp.bar_date LEFT JOIN cr ON cr.code = sp.code AND cr.bar_date = sp.bar_date WHERE NOT coalesce(crossed, false)),
cpf AS (SELECT * EXCLUDE (setup_score, risk_quality), monthly_score AS monthly_trend, weekly_score AS weekly_trend, setup_score / 100 AS setup_score, rps / 100 AS relative_strength, risk_quality / 100 AS risk_quality FROM cp)"""
PANEL_SQL = with_(BARS, BENCH, PRIM, PANEL_CTES) + f"SELECT {', '.join([*TEXTS, *DATES])}, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)}, {', '.join(FLAGS)} FROM cpf"

def heads_panel(spark, sf_dir) -> tuple[DataFrame, list]:
    """The panel with the inputs of the heads (without an adaptive registry: its neutral 50), and the walk-forward folds of its dates."""
    kept = ["code", "monthly_score", "weekly_score", "setup", "executable", "market_score", "permission", "has_120", "priority", *LABELS]
    rows = panel(spark, sf_dir).select(*kept, F.col("signal_date").alias("date"), F.col("setup_raw").alias("setup_score"), F.col("rps").alias("relative_strength"), (F.col("risk_quality") * 100).alias("risk_quality"), F.lit(50.0).alias("adaptive_score")).persist()
    rows = rows.withColumns({k: F.expr(e) for k, e in S.FEATURES.items()})
    span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return rows, L.L.walk_forward_folds(span["a"], span["b"]) if span["a"] else []


def calibrated_heads(spark, sf_dir):
    """Weights of the three heads of every walk-forward fold of the panel."""
    rows, folds = heads_panel(spark, sf_dir)
    return spark.createDataFrame(K.model_rows(K.fit_heads(rows, folds)), "fold int, samples long, head string, term string, weight double")


def calibrated_signals(spark, sf_dir):
    """State of every signal of the folds' validation parts, by the heads that were fitted before it."""
    rows, folds = heads_panel(spark, sf_dir)
    scored = K.predict_folds(rows, folds, K.fit_heads(rows, folds))
    given = scored.withColumnsRenamed({"early_stop": "stopped"}).withColumns(
        {"early_stop": F.col("early_stop_chance"), "history_ok": F.lit(True), "approved": F.col("samples") >= G.HIGH, "quality": F.lit("VALID"), "target": F.lit(False), **{k: F.lit(None).cast("double") for k in ("early_stop_max", "priority_min", "setup_min")}}
    )
    return S.signal_states(given).select("code", "date", "fold", "state", "reasons", "channel", "trend", "baseline", F.round("early_stop", 6).alias("early_stop"), F.round("win", 6).alias("win"), F.round("excess", 6).alias("excess"), "confidence", "stopped", "win_10d", F.round("excess_10d", 6).alias("excess_10d"))


QUERIES = {f.__name__: f for f in (calibration_panel, calibrated_heads, calibrated_signals)}
ORACLES = {"calibration_panel": PANEL_SQL}
