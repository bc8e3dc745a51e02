"""Labels, folds, grids, learners, costs and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import costs
from panelmill.operators import labels as L
from panelmill.operators import portfolio as P
from panelmill.operators import rotation as R
from panelmill.plans.crosssection_plan import BASE, FACTORS, panel
from panelmill.plans.sql import BARS, BENCH, with_
from panelmill.sources import bars as B


def cost_model_estimate(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lines.select(side.alias("side"), "l_linestatus", costs.estimate(side, price, F.col("l_quantity"), F.col("l_extendedprice") * (1 + F.col("l_discount") * 200)).alias("e"))
    return rows.groupBy("side", "l_linestatus").agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum("e.total_cost"), 2).alias("total_cost"), F.round(F.avg("e.impact_bps"), 6).alias("impact_bps"), F.count_if("e.capacity_exceeded").alias("capped"))


def _cost_sql():
    e = costs.estimate_sql("BUY", "(l_extendedprice / l_quantity)", "l_quantity", "(l_extendedprice * (1 + l_discount * 200))")
    return f"""SELECT CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_linestatus, count(*) AS trades, round(sum({e['total_cost']}), 2) AS total_cost, round(avg(18 * sqrt({e['participation']})), 6) AS impact_bps,
  count(*) FILTER ({e['gross']} / greatest(l_extendedprice * (1 + l_discount * 200), {e['gross']}) > 0.1::DOUBLE + 1e-12) AS capped FROM lineitem GROUP BY 1, 2"""


def capacity_lots(spark, sf_dir):
    rows = B.daily_bars(spark, sf_dir).withColumn("adv", F.round(F.avg("amount").over(Window.partitionBy("code").orderBy("date").rowsBetween(-19, 0)) * 5000, 2))
    return rows.select("code", "date", costs.capacity_lot(F.col("close"), F.col("adv")).alias("lots"))


LOTS_SQL = with_(BARS) + """SELECT code, date, CASE WHEN close > 0 AND adv > 0 THEN CAST(floor(adv * 0.1::DOUBLE / close / 100) * 100 AS BIGINT) ELSE 0 END AS lots FROM (
  SELECT *, round(avg(amount) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * 5000, 2) AS adv FROM b)"""


def forward_labels(spark, sf_dir):
    return L.forward_labels(B.daily_bars(spark, sf_dir), B.benchmark(spark, sf_dir))


def _labels_sql():
    lead = lambda c, n: f"lead({c}, {n}) OVER (PARTITION BY code ORDER BY date)"
    ahead = lambda f, n: f"{f} OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    names = ", ".join(f"{lead('close', h + 1)} AS close_{h}, {lead('bench', h + 1)} AS bench_{h}" for h in (5, 10, 20))
    entry = costs.estimate_sql("BUY", "entry_open", "shares", "adv")["effective_price"]
    sell = {h: costs.estimate_sql("SELL", f"close_{h}", "shares", "adv")["effective_price"] for h in (5, 10, 20)}
    own = {h: f"CASE WHEN close_{h} IS NOT NULL THEN {sell[h]} / entry - 1 ELSE 0 END" for h in sell}
    market = {h: f"CASE WHEN close_{h} IS NOT NULL THEN bench_{h} / bench_entry - 1 ELSE 0 END" for h in sell}
    outs = ", ".join(f"round({own[h]}, 6) AS return_{h}d, round({own[h]} - {market[h]}, 6) AS excess_{h}d" for h in sell)
    return with_(BARS, BENCH) + f"""SELECT code, date, entry_date, round(entry, 6) AS entry_price, CAST(low3 <= close * 0.95::DOUBLE AS INT) AS early_stop, {outs}, round(low20 / entry - 1, 6) AS adverse FROM (
  SELECT *, {entry} AS entry FROM (SELECT *, greatest(100000 / entry_open, 1) AS shares FROM (
    SELECT code, date, close, {lead('open', 1)} AS entry_open, {lead('date', 1)} AS entry_date, {lead('bench', 1)} AS bench_entry, {ahead('avg(amount)', 20)} AS adv, {ahead('min(low)', 3)} AS low3, {ahead('min(low)', 20)} AS low20, {names}
    FROM bars LEFT JOIN bm USING (date)) WHERE close_10 IS NOT NULL AND entry_open > 0))"""


def _folds(spark, sf_dir):
    span = B.table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b")).first()
    return L.walk_forward_folds(span["a"], span["b"])


def walk_forward(spark, sf_dir):
    return L.fold_report(spark, B.session_totals(spark, sf_dir).select("date"), _folds(spark, sf_dir))


#: business days n before or after a weekday-or-weekend date, as SQL on epoch days
WALK_SQL = with_(BARS) + """, days AS (SELECT CAST(d AS DATE) AS d, row_number() OVER (ORDER BY d) AS k FROM (SELECT unnest(generate_series(DATE '1993-01-01'::TIMESTAMP, DATE '2003-12-31'::TIMESTAMP, INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6),
span AS (SELECT min(date) AS a, max(date) AS z FROM bars),
f(fold, s) AS (SELECT 0, CAST(a + INTERVAL 24 MONTH AS DATE) FROM span UNION ALL
  SELECT fold + 1, (SELECT d FROM days WHERE k = (SELECT max(k) FROM days WHERE d <= CAST(f.s + INTERVAL 6 MONTH AS DATE)) + 5) FROM f, span WHERE CAST((SELECT d FROM days WHERE k = (SELECT max(k) FROM days WHERE d <= CAST(f.s + INTERVAL 6 MONTH AS DATE)) + 5) + INTERVAL 6 MONTH AS DATE) <= z),
g AS (SELECT fold, a, (SELECT d FROM days WHERE k = (SELECT min(k) FROM days WHERE d >= s) - 20) AS b, s, CAST(s + INTERVAL 6 MONTH AS DATE) AS e FROM f, span WHERE CAST(s + INTERVAL 6 MONTH AS DATE) <= z)
SELECT fold, part, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM (
  SELECT fold, 'train' AS part, date FROM bars JOIN g ON date >= a AND date < b UNION ALL SELECT fold, 'validate', date FROM bars JOIN g ON date >= s AND date < e) GROUP BY 1, 2""".replace("\n, days", ", days")
WALK_SQL = WALK_SQL.replace("\n, days AS", ", days AS")

STEPS = {"momentum_20": (-0.2, -0.1, 0.0, 0.1, 0.2), "trend_efficiency_20": (-0.2, 0.0, 0.2, 0.4), "volume_confirmation": (-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0), "reversal_5": (-0.5, -0.1, 0.0)}


def threshold_grid(spark, sf_dir):
    """Rows kept by each of 420 combinations of four thresholds, their share of all, forward return and share of stops."""
    rows = panel(spark, sf_dir).where("forward IS NOT NULL").select(*STEPS, "forward")
    whole = rows.agg(F.count(F.lit(1)).alias("whole"))  # one row
    met = L.threshold_grid(rows, STEPS, {"total": F.col("forward"), "stops": (F.col("forward") < -0.2).cast("double")}).join(F.broadcast(whole))
    keys = [f"t{i}" for i in range(len(STEPS))]
    return met.select(*keys, "kept", F.round(F.try_divide("kept", "whole"), 6).alias("retention"), F.round(F.try_divide("total", "kept"), 6).alias("mean_forward"), F.round(F.try_divide("stops", "kept"), 6).alias("stopped"))


GRID_SQL = with_(*BASE) + """SELECT t0, t1, t2, t3, count(p.forward) AS kept, round(count(p.forward) / max(whole)::DOUBLE, 6) AS retention, round(avg(p.forward), 6) AS mean_forward, round(avg(CASE WHEN p.forward < -0.2 THEN 1.0::DOUBLE WHEN p.forward IS NOT NULL THEN 0 END), 6) AS stopped
FROM (SELECT * FROM (SELECT count(*) AS whole FROM pan WHERE forward IS NOT NULL), """ + ", ".join(f"(SELECT unnest({list(v)}::DOUBLE[]) AS t{i})" for i, v in enumerate(STEPS.values())) + ") LEFT JOIN (SELECT * FROM pan WHERE forward IS NOT NULL) p ON " + " AND ".join(f"p.{c} >= t{i}" for i, c in enumerate(STEPS)) + " GROUP BY 1, 2, 3, 4"


def _monthly(spark, sf_dir) -> DataFrame:
    """Weekly returns of instruments beside those of the benchmark."""
    bench = B.benchmark(spark, sf_dir).withColumn("week", F.date_trunc("week", F.col("date").cast("timestamp")).cast("date")).groupBy("week").agg(F.max_by("bench", "date").alias("bench"))
    bench = bench.select(F.col("week").alias("date"), (F.col("bench") / F.lag("bench").over(Window.orderBy("week")) - 1).alias("rb"))  # one row a week
    rows = panel(spark, sf_dir).select("code", "date", (F.col("close") / F.lag("close").over(Window.partitionBy("code").orderBy("date")) - 1).alias("r"))
    return rows.join(bench, "date").where("r IS NOT NULL AND rb IS NOT NULL")


WEEKLY = """wr AS (SELECT * FROM (SELECT code, date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM pan) JOIN (
  SELECT week AS date, bench / lag(bench) OVER (ORDER BY week) - 1 AS rb FROM (SELECT date_trunc('week', date)::DATE AS week, arg_max(bench, date) AS bench FROM bm GROUP BY 1)) USING (date) WHERE r IS NOT NULL AND rb IS NOT NULL)"""


def yearly_returns(spark, sf_dir):
    return P.yearly_returns(_monthly(spark, sf_dir).select("code", "date", (F.col("r") / 100).alias("r"))).withColumn("compounded", F.round("compounded", 6))


def rolling_stability(spark, sf_dir):
    return P.rolling_stability(_monthly(spark, sf_dir).select("code", "date", (F.col("r") / 100).alias("r"), (F.col("rb") / 100).alias("rb")))


STABILITY_SQL = with_(*BASE, BENCH, WEEKLY) + """SELECT code, count(e) AS windows, round(avg(CASE WHEN e > 0 THEN 1.0::DOUBLE WHEN e IS NOT NULL THEN 0 END), 6) AS positive, round(min(e), 6) AS worst, round(quantile_cont(e, 0.5), 6) AS middle, round(max(dd), 6) AS worst_drawdown FROM (
  SELECT code, CASE WHEN k >= 52 THEN round(s - b0, 9) END AS e, 1 - nav / max(nav) OVER (PARTITION BY code ORDER BY date) AS dd FROM (
    SELECT code, date, row_number() OVER w AS k, product(1 + r / 100) OVER (w ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) - 1 AS s, product(1 + rb / 100) OVER (w ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) - 1 AS b0,
      exp(sum(ln(1 + r / 100)) OVER w) AS nav FROM wr WINDOW w AS (PARTITION BY code ORDER BY date))) GROUP BY code"""


def irls_fit(spark, sf_dir):
    rows = panel(spark, sf_dir).where("forward IS NOT NULL").select(F.year("date").alias("year"), *FACTORS, (F.col("forward") > 0).cast("int").alias("won"))
    return L.fit_by_group(rows, "year", FACTORS, "won")


def ridge_ensemble(spark, sf_dir):
    return L.ridge_weights(panel(spark, sf_dir).where("forward IS NOT NULL").select("date", *FACTORS, "forward"), FACTORS, "forward")


def rotation_backtest(spark, sf_dir):
    """The weekly rotation with rank buffers 0, 1, 2 and 3 as parameter sets."""
    rows = panel(spark, sf_dir).where("forward IS NOT NULL").withColumn("next_price", F.col("close") * (1 + F.col("forward"))).withColumn("adv", F.exp("liquidity_log"))
    ranked = R.top_by_group(R.rotation_score(rows), 6).select("date", "code", "rank", F.col("close").alias("price"), "next_price", "adv")
    sets = None
    for buffer in range(4):
        picks = R.buffered(ranked, 3, buffer).select(F.lit(buffer).alias("buffer"), "date", "code", "price", "next_price", "adv")
        sets = picks if sets is None else sets.unionByName(picks)
    return P.simulate(sets)


QUERIES = {f.__name__: f for f in (cost_model_estimate, capacity_lots, forward_labels, walk_forward, threshold_grid, yearly_returns, rolling_stability, irls_fit, ridge_ensemble, rotation_backtest)}
ORACLES = {
    "cost_model_estimate": _cost_sql(),
    "capacity_lots": LOTS_SQL,
    "forward_labels": _labels_sql(),
    "walk_forward": WALK_SQL,
    "threshold_grid": GRID_SQL,
    "yearly_returns": with_(*BASE, BENCH, WEEKLY) + "SELECT code, CAST(year(date) AS INT) AS year, round(product(1 + r / 100) - 1, 6) AS compounded FROM wr GROUP BY 1, 2",
    "rolling_stability": STABILITY_SQL,
}
