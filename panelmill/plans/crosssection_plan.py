"""Factor panel: scores across instruments, information coefficients, rotation ranks, market policy."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.functions import expressions as X
from panelmill.functions import windows as W
from panelmill.operators import crosssection as S
from panelmill.operators import policy as P
from panelmill.operators import rotation as R
from panelmill.operators.calendar import period_of
from panelmill.operators.factors import two_sided_normal
from panelmill.plans.indicators_plan import PRIM, PRIMITIVES, primitives
from panelmill.plans.sql import BARS, BENCH, with_
from panelmill.sources import bars as B

FACTORS = ["momentum_20", "momentum_60", "reversal_5", "trend_efficiency_20", "volume_confirmation"]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly signal rows: the last bar of each instrument in a week, from its 61st bar on; date is the week."""
    rows = primitives(spark, sf_dir).withColumn("week", period_of("week"))
    rows = rows.groupBy("code", "week").agg(*[F.max_by(c, "date").alias(c) for c in ("close", "n", *PRIMITIVES)]).where("n >= 61")
    group = F.concat(F.lit("g"), (F.regexp_extract("code", r"(\d+)", 1).cast("int") % 6).cast("string"))
    rows = rows.select("code", F.col("week").alias("date"), group.alias("industry_group"), "close", *[F.round(c, 9).alias(c) for c in PRIMITIVES])
    return rows.withColumn("forward", F.round(F.lead("close").over(W.by_code()) / F.col("close") - 1, 9))


PANEL = f"""wk AS (SELECT code, date_trunc('week', date)::DATE AS week, {', '.join(f'arg_max({c}, date) AS {c}' for c in ('close', 'n', *PRIMITIVES))} FROM pr GROUP BY 1, 2),
pan AS (SELECT code, week AS date, 'g' || CAST(CAST(regexp_extract(code, '(\\d+)', 1) AS INT) % 6 AS VARCHAR) AS industry_group, close, {', '.join(f'round({c}, 9) AS {c}' for c in PRIMITIVES)},
  round(lead(close) OVER (PARTITION BY code ORDER BY week) / close - 1, 9) AS forward FROM wk WHERE n >= 61)"""
BASE = (BARS, PRIM, PANEL)


def zscore_by_date(spark, sf_dir):
    return panel(spark, sf_dir).select("code", "date", *[F.round(S.zscore(c), 6).alias(c) for c in FACTORS])


def _z(c, by="date"):
    return f"({c} - avg({c}) OVER (PARTITION BY {by})) / greatest(stddev_pop({c}) OVER (PARTITION BY {by}), 1e-8)"


Z_SQL = with_(*BASE) + f"SELECT code, date, {', '.join(f'round({_z(c)}, 6) AS {c}' for c in FACTORS)} FROM pan"


def industry_neutral(spark, sf_dir):
    return S.neutralised(panel(spark, sf_dir), "momentum_20").select("code", "date", F.round("neutral", 6).alias("neutral"))


NEUTRAL_SQL = with_(*BASE) + f"""SELECT code, date, round({_z('d')}, 6) AS neutral FROM (SELECT code, date, momentum_20 - CASE WHEN count(*) OVER (PARTITION BY date, industry_group) >= 2
  THEN avg(momentum_20) OVER (PARTITION BY date, industry_group) ELSE avg(momentum_20) OVER (PARTITION BY date) END AS d FROM pan)"""


def percentile_ranks(spark, sf_dir):
    return panel(spark, sf_dir).select("code", "date", *[F.round(W.percentile_rank(c, "date"), 6).alias(c) for c in FACTORS])


def _pct(c):
    return f"((rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date))"


PCT_SQL = with_(*BASE) + f"SELECT code, date, {', '.join(f'round({_pct(c)}, 6) AS {c}' for c in FACTORS)} FROM pan"


def _ics(spark, sf_dir) -> DataFrame:
    rows = panel(spark, sf_dir)
    # One pass over the panel: each row becomes one row a factor, and the date of a factor is its own cross-section.
    long = rows.select("code", "date", "forward", F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("value")) for c in FACTORS])).alias("f")).select("code", "date", "forward", "f.*")
    keyed = long.withColumn("date", F.struct("date", "factor"))
    return S.rank_ic(keyed, "value", "forward").select(F.col("date.factor").alias("factor"), F.col("date.date").alias("date"), "n", F.round("ic", 9).alias("ic"))


IC = "lo AS (" + " UNION ALL ".join(f"SELECT code, date, forward, '{c}' AS factor, {c} AS value FROM pan WHERE forward IS NOT NULL" for c in FACTORS) + """),
rk AS (SELECT factor, date, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY factor, date) AS a,
  (rank() OVER (PARTITION BY factor, date ORDER BY forward) + (count(*) OVER (PARTITION BY factor, date, forward) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY factor, date) AS b FROM lo),
ic AS (SELECT factor, date, n, round(c / sqrt(va * vb), 9) AS ic FROM (SELECT factor, date, count(*) AS n, covar_pop(a, b) AS c, var_pop(a) AS va, var_pop(b) AS vb FROM rk GROUP BY 1, 2) WHERE n >= 3 AND va > 1e-12 AND vb > 1e-12)"""
SUMMARY = """su AS (SELECT factor, count(*) AS dates, round(avg(ic), 6) AS ic_mean, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(52), 6) AS ic_ir, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)), 6) AS ic_t,
  round(avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive, round(avg(CASE WHEN rn <= 26 THEN ic END), 6) AS recent_mean FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS rn FROM ic) GROUP BY factor)"""


def rank_ic(spark, sf_dir):
    return _ics(spark, sf_dir).withColumn("ic", F.round("ic", 6))


def ic_summary(spark, sf_dir):
    return S.ic_summary(_ics(spark, sf_dir))


def bh_adjust(spark, sf_dir):
    rows = S.ic_summary(_ics(spark, sf_dir)).select("factor", F.round(two_sided_normal(F.coalesce("ic_t", F.lit(0.0))), 6).alias("p"))
    return S.benjamini_hochberg(rows).select("factor", "p", F.round("q", 6).alias("q"))


#: The error function of x by its series; the query takes it from Python's library.
ERF = "CASE WHEN x > 6 THEN 1 ELSE 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 300), lambda n: exp(n * ln(2) + (2 * n + 1) * ln(greatest(x, 1e-300)) - (lgamma(n + 1.5) + (n + 1) * ln(2) - 0.5 * ln(pi()))))) END"
BH_SQL = with_(*BASE, IC, SUMMARY) + f"""SELECT factor, p, round(least(1, min(raw) OVER (ORDER BY rk DESC)), 6) AS q FROM (SELECT factor, p, rk, p * count(*) OVER () / rk AS raw FROM (
  SELECT factor, p, row_number() OVER (ORDER BY p, factor) AS rk FROM (SELECT factor, round(1 - ({ERF}), 6) AS p FROM (SELECT factor, abs(coalesce(ic_t, 0)) / sqrt(2) AS x FROM su))))"""


def factor_turnover(spark, sf_dir):
    return S.top_quartile_turnover(panel(spark, sf_dir), "momentum_20").withColumn("turnover", F.round("turnover", 6))


TURNOVER_SQL = with_(*BASE) + """, h AS (SELECT code, dense_rank() OVER (ORDER BY date) AS t, date, row_number() OVER (PARTITION BY date ORDER BY momentum_20 DESC, code) AS rk, ceil(count(*) OVER (PARTITION BY date) * 0.25) AS k FROM pan),
w AS (SELECT code, t, 1 / k AS w FROM h WHERE rk <= k)
SELECT date, round(tv, 6) AS turnover FROM (SELECT t, sum(abs(d)) / 2 AS tv FROM (SELECT t, code, sum(w) AS d FROM (SELECT code, t, w FROM w UNION ALL SELECT code, t + 1, -w FROM w) GROUP BY 1, 2) GROUP BY t)
JOIN (SELECT DISTINCT t, date FROM h) USING (t) WHERE t > 1""".replace(", h AS", ", h AS", 1)
TURNOVER_SQL = TURNOVER_SQL.replace("\n, h AS", ", h AS")

EXPRESSION = "add(div(momentum_20, volatility_20), signed_sqrt(sub(volume_confirmation, neg(reversal_5))))"


def factor_expr_eval(spark, sf_dir):
    tree = X.parse(EXPRESSION)
    if found := X.problems(tree, set(PRIMITIVES)):
        raise ValueError(found)
    rows = panel(spark, sf_dir).withColumns({f"z_{c}": F.round(S.zscore(c), 9) for c in sorted(X.names(tree))})
    return rows.select("code", "date", F.round(X.column(tree, lambda n: F.col(f"z_{n}")), 6).alias("value"))


def _clip20(x):
    return f"greatest(-20, least(20, {x}))"


EXPR_SQL = with_(*BASE) + f"""SELECT code, date, round({_clip20(_clip20("a / CASE WHEN abs(b) < 0.25 THEN CASE WHEN b < 0 THEN -0.25 ELSE 0.25 END ELSE b END") + " + " + _clip20("sign(s) * sqrt(abs(s))"))}, 6) AS value
FROM (SELECT code, date, a, b, {_clip20("c - " + _clip20("-d"))} AS s FROM (SELECT code, date, round({_z('momentum_20')}, 9) AS a, round({_z('volatility_20')}, 9) AS b, round({_z('volume_confirmation')}, 9) AS c, round({_z('reversal_5')}, 9) AS d FROM pan))"""


def relative_strength(spark, sf_dir):
    return R.relative_strength(B.daily_bars(spark, sf_dir), B.benchmark(spark, sf_dir))


def _rs_sql():
    h = (20, 60, 120)
    w = lambda n: f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    alpha = lambda n: f"ln(close / lag(close, {n}) OVER (PARTITION BY code ORDER BY date)) - beta * ln(bench / lag(bench, {n}) OVER (PARTITION BY code ORDER BY date))"
    tail = {n: max(60, n) for n in h}
    te = lambda n: f"sqrt(greatest(var_samp(ra) {w(tail[n])} + beta * beta * var_samp(rb) {w(tail[n])} - 2 * beta * covar_samp(ra, rb) {w(tail[n])}, 0)) * sqrt({n})"
    raw = ", ".join(f"CASE WHEN m > {n + 1} THEN round(({alpha(n)}) / greatest({te(n)}, 0.01), 9) END AS raw{n}" for n in h)
    pct = ", ".join(f"CASE WHEN raw{n} IS NOT NULL THEN (rank() OVER (PARTITION BY raw{n} IS NULL ORDER BY c{n}) + (count(*) OVER (PARTITION BY raw{n} IS NULL, c{n}) - 1) / 2.0::DOUBLE) / count(raw{n}) OVER () * 100 END AS p{n}" for n in h)
    cut = ", ".join(f"greatest((SELECT quantile_cont(raw{n}, 0.05) FROM l), least((SELECT quantile_cont(raw{n}, 0.95) FROM l), raw{n})) AS c{n}" for n in h)
    return with_(BARS, BENCH) + f""", j AS (SELECT code, date, close, bench, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ra, bench / lag(bench) OVER (PARTITION BY code ORDER BY date) - 1 AS rb,
  row_number() OVER (PARTITION BY code ORDER BY date) AS m, count(*) OVER (PARTITION BY code) AS t FROM bars JOIN bm USING (date)),
be AS (SELECT *, CASE WHEN m >= 21 AND var_pop(rb) {w(120)} > 1e-10 THEN greatest(-0.5, least(2.5, covar_samp(ra, rb) {w(120)} / var_pop(rb) {w(120)})) ELSE 1 END AS beta FROM j),
l AS (SELECT code, beta, raw20, raw60, raw120 FROM (SELECT *, {raw} FROM be) WHERE m = t),
c AS (SELECT *, {cut} FROM l), p AS (SELECT code, beta, {pct} FROM c)
SELECT code, round(beta, 4) AS beta, p120 IS NOT NULL AS has_120,
  round(greatest(0, least(100, coalesce((coalesce(p20, 0) * 0.5 + coalesce(p60, 0) * 0.3 + coalesce(p120, 0) * 0.2) / nullif(CASE WHEN p20 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN p60 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN p120 IS NULL THEN 0 ELSE 0.2 END, 0), 0))), 3) AS score FROM p""".replace("\n, j AS", ", j AS")


def market_policy(spark, sf_dir):
    """Breadth, policy pulse and exposure of every week."""
    weekly = panel(spark, sf_dir).withColumn("weekly_score", F.col("trend_efficiency_20"))
    bench = B.benchmark(spark, sf_dir)
    w = Window.orderBy("date")
    # One row a session: the benchmark is a single series.
    rets = bench.select("date", *[F.coalesce(F.round(F.col("bench") / F.lag("bench", k).over(w) - 1, 9), F.lit(0.0)).alias(f"ret_{k}") for k in (1, 3, 5, 10)])
    rets = rets.withColumn("week", period_of("week")).groupBy("week").agg(*[F.max_by(f"ret_{k}", "date").alias(f"ret_{k}") for k in (1, 3, 5, 10)]).withColumnRenamed("week", "date")
    breadth = weekly.groupBy("date").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("weekly_score") >= 0.25).alias("bull"), F.count_if(F.col("weekly_score") <= -0.25).alias("bear"), F.round(F.avg("weekly_score"), 9).alias("trend"), F.round(F.avg("volatility_20"), 9).alias("vol"))
    # The rank of a week's volatility among the last 120 weeks, later ones excluded. One row a week.
    past = F.collect_list("vol").over(Window.orderBy("date").rowsBetween(-119, 0))
    rows = breadth.join(rets, "date").withColumn("past", past)
    below, equal = F.size(F.filter("past", lambda x: x < F.col("vol"))), F.size(F.filter("past", lambda x: x == F.col("vol")))
    rows = rows.withColumn("stress", F.round((below + (equal + 1) / 2) / F.size("past") * 100, 6)).drop("past")
    return P.market_policy(rows).select("date", "bull", "bear", "total", "raw_score", "pulse", "score", "state", "permission", "exposure")


def market_policy_sql():
    ret = ", ".join(f"coalesce(round(bench / lag(bench, {k}) OVER (ORDER BY date) - 1, 9), 0) AS ret_{k}" for k in (1, 3, 5, 10))
    last = ", ".join(f"arg_max(ret_{k}, date) AS ret_{k}" for k in (1, 3, 5, 10))
    return with_(*BASE, BENCH) + f""", rt AS (SELECT date_trunc('week', date)::DATE AS date, {last} FROM (SELECT date, {ret} FROM bm) GROUP BY 1),
br AS (SELECT date, count(*) AS total, count(*) FILTER (trend_efficiency_20 >= 0.25) AS bull, count(*) FILTER (trend_efficiency_20 <= -0.25) AS bear, round(avg(trend_efficiency_20), 9) AS trend, round(avg(volatility_20), 9) AS vol FROM pan GROUP BY date),
st AS (SELECT * EXCLUDE (past), round((len(list_filter(past, lambda x: x < vol)) + (len(list_filter(past, lambda x: x = vol)) + 1) / 2.0::DOUBLE) / len(past) * 100, 6) AS stress FROM (
  SELECT *, list(vol) OVER (ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS past FROM br JOIN rt USING (date))),
""".replace("\n, rt AS", ", rt AS") + P.policy_sql("st") + "SELECT date, bull, bear, total, raw_score, pulse, score, state, permission, exposure FROM policy"


def rotation_score(spark, sf_dir):
    scored = R.rotation_score(panel(spark, sf_dir))
    return scored.select("date", "code", F.round("rotation_score", 6).alias("rotation_score"))


def _weights(pairs):
    total = sum(w for _, w in pairs)
    return [(c, w / total) for c, w in pairs]


ROT = "sc AS (SELECT *, round(" + " + ".join(f"{w!r}::DOUBLE * {_pct(c)}" for c, w in _weights(R.SLICE_WEIGHTS)) + ", 9) AS rotation_score FROM pan)"


def rotation_top3(spark, sf_dir):
    picks = R.top_by_group(R.rotation_score(panel(spark, sf_dir)), 3)
    return picks.select("date", "rank", "code", "industry_group", F.round("rotation_score", 6).alias("rotation_score"))


TOP = """g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, industry_group ORDER BY rotation_score DESC, code) AS gr FROM sc) WHERE gr = 1),
tp AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rotation_score DESC, code) AS rank FROM g)"""


def rank_buffer_retention(spark, sf_dir):
    """Three names a week; names picked fresh the week before stay while they rank within the buffer."""
    return R.buffered(R.top_by_group(R.rotation_score(panel(spark, sf_dir)), 6), 3, 3).select("date", "code", "rank", "incumbent")


BUFFER_SQL = with_(*BASE, ROT, TOP) + """, wk2 AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM tp)),
x AS (SELECT tp.date, code, rank, t FROM tp JOIN wk2 USING (date) WHERE rank <= 6),
y AS (SELECT x.date, x.code, x.rank, p.code IS NOT NULL AS incumbent FROM x LEFT JOIN x p ON p.t = x.t - 1 AND p.code = x.code AND p.rank <= 3)
SELECT date, code, CAST(rank AS INT) AS rank, incumbent FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY incumbent DESC, rank) AS k FROM y) WHERE k <= 3""".replace("\n, wk2", ", wk2")

QUERIES = {f.__name__: f for f in (zscore_by_date, industry_neutral, percentile_ranks, rank_ic, ic_summary, bh_adjust, factor_turnover, factor_expr_eval, relative_strength, market_policy, rotation_score, rotation_top3, rank_buffer_retention)}
ORACLES = {
    "zscore_by_date": Z_SQL,
    "industry_neutral": NEUTRAL_SQL,
    "percentile_ranks": PCT_SQL,
    "rank_ic": with_(*BASE, IC) + "SELECT factor, date, n, round(ic, 6) AS ic FROM ic",
    "ic_summary": with_(*BASE, IC, SUMMARY) + "SELECT * FROM su",
    "bh_adjust": BH_SQL,
    "factor_turnover": TURNOVER_SQL,
    "factor_expr_eval": EXPR_SQL,
    "relative_strength": _rs_sql(),
    "market_policy": market_policy_sql(),
    "rotation_score": with_(*BASE, ROT) + "SELECT date, code, round(rotation_score, 6) AS rotation_score FROM sc",
    "rotation_top3": with_(*BASE, ROT, TOP) + "SELECT date, CAST(rank AS INT) AS rank, code, industry_group, round(rotation_score, 6) AS rotation_score FROM tp WHERE rank <= 3",
    "rank_buffer_retention": BUFFER_SQL,
}
