"""Rule scores of confirmed months and weeks and of days."""

from __future__ import annotations

from panelmill.operators import calendar as C
from panelmill.operators import ladders as L
from panelmill.plans.bars_plan import AS_OF, ORACLES as BAR_SQL
from panelmill.plans.indicators_plan import over
from panelmill.plans.sql import BARS, with_
from panelmill.sources import bars as B


def _bars(spark, sf_dir, unit):
    bars = B.daily_bars(spark, sf_dir)
    return bars if unit == "day" else C.confirmed(bars, B.sessions(spark, sf_dir), unit, AS_OF)


def monthly_ladder(spark, sf_dir):
    return L.scored(L.inputs(_bars(spark, sf_dir, "month"), "month"), "month").select("code", "date", "rule", "score")


def weekly_ladder(spark, sf_dir):
    return L.scored(L.inputs(_bars(spark, sf_dir, "week"), "week"), "week").select("code", "date", "rule", "score")


def daily_ladder(spark, sf_dir):
    return L.scored(L.inputs(_bars(spark, sf_dir, "day"), "day"), "day").select("code", "date", "rule", "tags", "score")


OVER = "OVER (PARTITION BY code ORDER BY date)"
_DIF = "(r.e12 * (1 - 2::DOUBLE / 13) + b.close * (2::DOUBLE / 13) - (r.e26 * (1 - 2::DOUBLE / 27) + b.close * (2::DOUBLE / 27)))"
_FOLD = f"""lw(code, n, close, e12, e26, dea, gain, loss) AS (SELECT code, n, close, close, close, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM lb WHERE n = 1 UNION ALL
  SELECT b.code, b.n, b.close, r.e12 * (1 - 2::DOUBLE / 13) + b.close * (2::DOUBLE / 13), r.e26 * (1 - 2::DOUBLE / 27) + b.close * (2::DOUBLE / 27),
    r.dea * (1 - 2::DOUBLE / 10) + {_DIF} * (2::DOUBLE / 10), r.gain * (1 - 1::DOUBLE / 14) + greatest(b.close - r.close, 0) * (1::DOUBLE / 14), r.loss * (1 - 1::DOUBLE / 14) + greatest(r.close - b.close, 0) * (1::DOUBLE / 14)
  FROM lw r JOIN lb b ON b.code = r.code AND b.n = r.n + 1)"""
_MEANS = ", ".join(f"CASE WHEN n >= {n} THEN avg(close) {over(n)} END AS ma{n}" for n in (5, 10, 20))
_SLOPES = ", ".join(f"(ma{n} - lag(ma{n}, 3) {OVER}) / nullif(lag(ma{n}, 3) {OVER}, 0) * 100 AS slope{n}" for n in (5, 10, 20))
_HISTS = ", ".join(f"lag(hist, {k}) {OVER} AS h{k}" for k in range(4))
_EXTRA = {
    "month": f"lag(close, 3) {OVER} AS close3, lag(close, 6) {OVER} AS close6",
    "week": f"max(high) {over(12)} AS high12, min(low) {over(12)} AS low12, CASE WHEN n > 12 THEN max(high) {over(12, 1)} END AS high12p, CASE WHEN n > 12 THEN min(low) {over(12, 1)} END AS low12p",
    "day": f"""CASE WHEN n >= 20 THEN stddev_samp(close) {over(20)} END AS sd20, CASE WHEN n >= 14 THEN avg(tr) {over(14)} END AS atr, lag(close) {OVER} AS previous,
    CASE WHEN n > 20 THEN max(high) {over(20, 1)} END AS high20p, CASE WHEN n > 20 THEN min(low) {over(20, 1)} END AS low20p,
    {' + '.join(f'{5 - 2 * k} * lag(close, {k}) {OVER}' for k in range(6))} AS price_slope, {' + '.join(f'{5 - 2 * k} * lag(volume, {k}) {OVER}' for k in range(6))} AS volume_slope,
    CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END AS rsi, list(close) {over(30)} AS cs, list(hist) {over(30)} AS hs""",
}
_PARTS = {"a": "[1:len(cs) // 2]", "z": "[len(cs) // 2 + 1:]"}
_HALVES = ", ".join(f"list_{f}(cs{p}) AS {k}_{n}, list_position(cs{p}, list_{f}(cs{p})) AS {k}_{n}_at, hs{p}[list_position(cs{p}, list_{f}(cs{p}))] AS {k}_{n}_h" for n, p in _PARTS.items() for k, f in (("high", "max"), ("low", "min")))


def _sql(unit):
    rows = with_(BARS) + "SELECT code, date, open, high, low, close, volume FROM bars" if unit == "day" else BAR_SQL[f"bars_{unit}ly_confirmed"]
    inner = f"""WITH RECURSIVE l0 AS ({rows}),
lb AS (SELECT *, row_number() {OVER} AS n, count(*) OVER (PARTITION BY code) AS bars, CASE WHEN lag(close) {OVER} IS NULL THEN high - low ELSE greatest(high, lag(close) {OVER}) - least(low, lag(close) {OVER}) END AS tr FROM l0),
{_FOLD},
l1 AS (SELECT lb.*, gain, loss, round(e12 - e26 - dea, 9) AS hist, {_MEANS.replace('n >= ', 'lb.n >= ').replace('avg(close)', 'avg(lb.close)').replace('PARTITION BY code', 'PARTITION BY lb.code')} FROM lb JOIN lw ON lb.code = lw.code AND lb.n = lw.n),
l2 AS (SELECT *, {_SLOPES}, {_HISTS}, CASE WHEN n >= 20 THEN avg(volume) {over(20)} END AS vma, {_EXTRA[unit]} FROM l1),
l3 AS (SELECT *{', ' + _HALVES if unit == 'day' else ''} FROM l2 WHERE n = bars)"""
    source = "l3"
    for k, step in enumerate(L.steps(unit)):
        inner += f",\nm{k} AS (SELECT *, {', '.join(f'{e} AS {name}' for name, e in step.items())} FROM {source})"
        source = f"m{k}"
    return inner + f"\nSELECT code, date, rule, {'tags, ' if unit == 'day' else ''}score FROM {source}"


QUERIES = {f.__name__: f for f in (monthly_ladder, weekly_ladder, daily_ladder)}
ORACLES = {"monthly_ladder": _sql("month"), "weekly_ladder": _sql("week"), "daily_ladder": _sql("day")}
