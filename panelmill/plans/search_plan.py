"""Environment scores, exposure caps, capacity-aware targets, event exits and factor search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.functions import folds as E
from panelmill.functions import windows as W
from panelmill.operators import rotation as R
from panelmill.operators import scores as C
from panelmill.operators import search as H
from panelmill.plans import crosssection_plan as X
from panelmill.plans import factors_plan as P
from panelmill.plans.indicators_plan import E9, E12, E26, OVER, TR, over
from panelmill.plans.labels_plan import WEEKLY, _monthly
from panelmill.plans.sql import BARS, BENCH, with_
from panelmill.sources import bars as B
from panelmill.sources import cuts


def environment_scores(spark, sf_dir):
    """Trend, momentum, volume and volatility points of each instrument at its last bar, and what follows from their total."""
    rows = B.numbered_bars(spark, sf_dir).withColumn("tr", W.true_range()).withColumn("previous", W.lag("close", 1))
    rows = rows.withColumns({**{f"ma{n}": F.round(W.sma("close", n), 9) for n in (20, 60, 120)}, "vma": W.sma("volume", 20), "natr": F.round(F.avg("tr").over(W.last_n(14)) / F.col("close"), 9)})
    h = E.histories(rows, "close", "previous", "ma20", "ma60", "ma120", "volume", "vma", "natr").withColumn("c", E.values("close"))
    h = h.withColumn("dif", F.zip_with(E.ewm(F.col("c"), 2 / 13), E.ewm(F.col("c"), 2 / 27), lambda a, b: a - b))
    h = h.withColumn("hist", F.zip_with("dif", E.ewm(F.col("dif"), 2 / 10), lambda a, b: F.round(a - b, 9)))
    h = h.withColumns({"x": F.element_at("h", -1), "bars": F.size("h"), "seen": F.slice(E.values("natr"), F.greatest(F.size("h") - 119, F.lit(1)), 120)})
    below = F.size(F.filter("seen", lambda v: v < F.col("x.natr"))) / F.size("seen") * 100
    inputs = h.select(
        "code", "bars", "x.close", "x.previous", "x.ma20", "x.ma60", "x.ma120",
        *[F.try_element_at("hist", F.lit(-1 - k)).alias(f"h{k}") for k in range(4)],
        F.round(F.coalesce(F.try_divide(F.col("x.volume"), F.col("x.vma")), F.lit(1.0)), 9).alias("vr"),
        F.round(F.col("x.natr") * 100, 6).alias("atr_pct"),
        F.round(F.when(F.col("bars") >= 20, below).otherwise(50.0), 6).alias("pctl"),
    )
    return C.environment(inputs).select("code", "trend", "momentum", "volume", "volatility", "total", "status", "risk_level", "atr_multiplier")


def _columns(step):
    return ", ".join(f"{e} AS {k}" for k, e in step.items())


ENVIRONMENT_SQL = with_(
    BARS,
    f"w(code, n, e12, e26, dea) AS (SELECT code, n, close, close, 0::DOUBLE FROM b WHERE n = 1 UNION ALL SELECT b.code, b.n, {E12}, {E26}, {E9.format(E12, E26)} FROM w r JOIN b ON b.code = r.code AND b.n = r.n + 1)",
    "hh AS (SELECT code, n, h0, " + ", ".join(f"lag(h0, {k}) OVER (PARTITION BY code ORDER BY n) AS h{k}" for k in (1, 2, 3)) + " FROM (SELECT code, n, round(e12 - e26 - dea, 9) AS h0 FROM w))",
    f"t1 AS (SELECT *, lag(close) {OVER} AS previous, count(*) OVER (PARTITION BY code) AS bars, " + ", ".join(f"CASE WHEN n >= {k} THEN round(avg(close) {over(k)}, 9) END AS ma{k}" for k in (20, 60, 120)) + f", CASE WHEN n >= 20 THEN avg(volume) {over(20)} END AS vma, round(avg(tr) {over(14)} / close, 9) AS natr FROM (SELECT *, {TR} AS tr FROM b))",
    f"t2 AS (SELECT *, list(natr) {over(120)} AS seen FROM t1)",
    "t3 AS (SELECT t2.code, bars, close, previous, ma20, ma60, ma120, h0, h1, h2, h3, round(coalesce(volume / vma, 1), 9) AS vr, round(natr * 100, 6) AS atr_pct, round(CASE WHEN bars >= 20 THEN len(list_filter(seen, lambda x: x < natr)) / len(seen) * 100 ELSE 50 END, 6) AS pctl FROM t2 JOIN hh USING (code, n) WHERE n = bars)",
    f"t4 AS (SELECT *, {_columns(C.PARTS)} FROM t3)",
    f"t5 AS (SELECT *, {_columns(C.FINAL)} FROM t4)",
) + f"SELECT code, trend, momentum, volume, volatility, total, {_columns(C.REPORT)} FROM t5"


def exposure_caps(spark, sf_dir):
    """Caps of each instrument's weekly path against the benchmark, and the exposure where the week's market state lets the cap act."""
    w = Window.partitionBy("code").orderBy("date")
    nav = lambda r: F.round(F.exp(F.sum(F.ln(1 + F.col(r) / 100)).over(w)), 12)
    paths = _monthly(spark, sf_dir).select("code", "date", nav("r").alias("s"), nav("rb").alias("b"))
    rows = C.exposure_caps(paths).join(X.market_policy(spark, sf_dir).select("date", "state", "score"), "date")
    return rows.select("code", "date", "life_dd", "healing", "cap", F.expr(f"CASE WHEN {C.APPLIES} THEN cap ELSE CAST(1 AS DOUBLE) END").alias("exposure"))


def _last(k):
    return f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _cap_sql():
    policy = X.market_policy_sql()
    steps = "".join(f", k{i + 1} AS (SELECT *, {_columns(s)} FROM k{i})" for i, s in enumerate(C.CAP_STEPS))
    return policy[: policy.rindex("SELECT date, bull")].rstrip().rstrip(",") + f""", {WEEKLY},
n0 AS (SELECT code, date, round(exp(sum(ln(1 + r / 100)) {OVER}), 12) AS s, round(exp(sum(ln(1 + rb / 100)) {OVER}), 12) AS b FROM wr),
n1 AS (SELECT *, row_number() {OVER} AS k, max(s) {OVER} AS peak, max(s) {_last(C.TRAIL)} AS trail, (s / first_value(s) {OVER}) / (b / first_value(b) {OVER}) AS rel, max(b) {OVER} AS b_peak, min(s) {_last(C.LOOKBACK)} AS low, min(b) {_last(C.LOOKBACK)} AS b_low FROM n0),
n2 AS (SELECT *, round(1 - s / peak, 9) AS dd, round(1 - s / trail, 9) AS trail_dd, round(1 - rel / max(rel) {OVER}, 9) AS rel_dd, round((s - low) / peak, 9) AS from_trough, round((b - b_low) / b_peak, 9) AS bench_up FROM n1),
k0 AS (SELECT *, dd AS life_dd, lag(dd) {OVER} AS dd1, lag(dd, 2) {OVER} AS dd2, dd >= max(dd) {_last(C.LOOKBACK)} - 1e-12 AS new_low FROM n2){steps}
SELECT code, date, life_dd, healing, cap, CASE WHEN {C.APPLIES} THEN cap ELSE 1::DOUBLE END AS exposure FROM k{len(C.CAP_STEPS)} JOIN policy USING (date)"""


VALUE, NAMES, PARTICIPATION = 15_000.0, 3, 0.10


def capacity_targets(spark, sf_dir):
    scored = R.rotation_score(X.panel(spark, sf_dir)).withColumn("adv", F.round(F.exp("liquidity_log"), 2))
    return C.capacity_targets(scored, VALUE, NAMES, PARTICIPATION)


CAPACITY_SQL = with_(*X.BASE, X.ROT) + f"""SELECT date, code, CAST(rank AS INT) AS rank, CAST(names AS INT) AS names FROM (
  SELECT *, greatest(1, coalesce(list_extract(m, greatest(1, coalesce(list_extract(m, greatest(1, coalesce(list_extract(m, {NAMES}), 0))), 0))), 0)) AS final FROM (
    SELECT *, list_transform([1, 2, 3], lambda d: len(list_filter(list(names) OVER (PARTITION BY date), lambda x: x = d))) AS m FROM (
      SELECT *, row_number() OVER (PARTITION BY date, names ORDER BY rotation_score DESC, code) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY date, names, industry_group ORDER BY rotation_score DESC, code) AS g FROM (
          SELECT date, code, industry_group, rotation_score, names FROM sc, (SELECT unnest([1, 2, 3]) AS names) WHERE round(exp(liquidity_log), 2) >= {VALUE} / names / {PARTICIPATION}))
      WHERE g = 1) WHERE rank <= {NAMES})) WHERE names = final"""


def event_exits(spark, sf_dir):
    """Each breakout above 20 bars, entered at the next open with the 10-bar low as stop: how and where it ends.

    From the bar after entry on, a low at or below the stop sells at the worse of stop and open; the tenth bar sells at its
    close; an event with fewer bars ahead is open. Forward windows over one partitioning, no walk.
    """
    rows = B.numbered_bars(spark, sf_dir).withColumns({"high20": F.max("high").over(W.last_n(20, 1)), "stop": F.min("low").over(W.last_n(10, 1)), "entry_date": F.lead("date").over(W.by_code()), "entry": F.lead("open").over(W.by_code())})
    rows = rows.withColumn("ahead", F.collect_list(F.struct("date", "open", "low", "close")).over(W.by_code().rowsBetween(2, 11)))
    rows = rows.where("n > 20 AND close >= high20 AND entry > stop")
    hit, last = F.get(F.filter("ahead", lambda x: x["low"] <= F.col("stop")), F.lit(0)), F.get("ahead", F.lit(9))
    rows = rows.withColumns({"hit": hit, "last": last})
    kind = F.when(F.col("hit").isNotNull(), "STOP").when(F.col("last").isNotNull(), "TIME").otherwise("OPEN")
    price = F.when(F.col("hit").isNotNull(), F.least(F.col("stop"), F.col("hit.open"))).otherwise(F.col("last.close"))
    return rows.select("code", "date", "entry_date", kind.alias("exit"), F.coalesce("hit.date", "last.date").alias("exit_date"), F.round(price / F.col("entry") - 1, 6).alias("outcome"))


EXITS_SQL = with_(BARS) + f"""SELECT code, date, entry_date, CASE WHEN hit IS NOT NULL THEN 'STOP' WHEN last IS NOT NULL THEN 'TIME' ELSE 'OPEN' END AS exit, coalesce(hit.date, last.date) AS exit_date,
  round(CASE WHEN hit IS NOT NULL THEN least(stop, hit.open) ELSE last.close END / entry - 1, 6) AS outcome FROM (
  SELECT *, list_filter(ahead, lambda x: x.low <= stop)[1] AS hit, ahead[10] AS last FROM (
    SELECT *, max(high) {over(20, 1)} AS high20, min(low) {over(10, 1)} AS stop, lead(date) {OVER} AS entry_date, lead(open) {OVER} AS entry,
      list({{'date': date, 'open': open, 'low': low, 'close': close}}) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 2 FOLLOWING AND 11 FOLLOWING) AS ahead FROM b)
  WHERE n > 20 AND close >= high20 AND entry > stop)"""


def _labelled(spark, sf_dir):
    """Labelled rows of the panel, derived once: a search reads them several times a generation."""
    return cuts.stored(X.panel(spark, sf_dir).where("forward IS NOT NULL").select("date", "code", "forward", *X.PRIMITIVES))


def factor_diversity(spark, sf_dir):
    """Factors by mean coefficient, and whether each is kept: one that duplicates a better kept one is not. The greedy step runs over a row a factor."""
    order = [r["factor"] for r in X.ic_summary(spark, sf_dir).orderBy(F.desc("ic_mean"), "factor").select("factor").collect()]
    copies = {(r["factor"], r["other"]) for r in P.coefficient_diversity(spark, sf_dir).where("duplicate").collect()}
    kept = set(H.diverse(order, copies))
    return spark.createDataFrame([(f, i + 1, f in kept) for i, f in enumerate(order)], "factor string, place int, kept boolean")


DIVERSE_SQL = with_(*X.BASE, X.IC, X.SUMMARY, f"dv AS ({P.DIVERSITY_SQL[P.DIVERSITY_SQL.rindex('SELECT factor, other, dates'):]})",
    "dl AS (SELECT coalesce(list(factor || '|' || other) FILTER (duplicate), []) AS d FROM dv)",
    "oo AS (SELECT factor, row_number() OVER (ORDER BY ic_mean DESC, factor) AS place FROM su)",
    """gr(place, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT o.place, CASE WHEN len(list_filter(g.kept, lambda x: list_contains(d.d, x || '|' || o.factor) OR list_contains(d.d, o.factor || '|' || x))) > 0 THEN g.kept ELSE list_append(g.kept, o.factor) END FROM gr g JOIN oo o ON o.place = g.place + 1, dl d)""",
) + "SELECT factor, CAST(place AS INT) AS place, list_contains((SELECT kept FROM gr ORDER BY place DESC LIMIT 1), factor) AS kept FROM oo"


def genetic_factors(spark, sf_dir):
    """The evolved expressions, fittest first."""
    found = H.evolve(_labelled(spark, sf_dir), list(X.PRIMITIVES))
    return spark.createDataFrame([(i + 1, r["expression"], r["generation"], r["fitness"], r["ic_mean"], r["turnover"]) for i, r in enumerate(found)], "place int, expression string, generation int, fitness double, ic_mean double, turnover double")


def complementary_factors(spark, sf_dir):
    """Sets of two and three factors, with weights, gain over the best single one, and why a set is not taken."""
    found = H.complementary_sets(_labelled(spark, sf_dir), X.FACTORS)
    return spark.createDataFrame([(r["set"], r["weights"], r["ic_mean"], r["gain"], r["score"], r["reasons"]) for r in found], "members string, weights array<double>, ic_mean double, gain double, score double, reasons array<string>")


QUERIES = {f.__name__: f for f in (environment_scores, exposure_caps, capacity_targets, event_exits, factor_diversity, genetic_factors, complementary_factors)}
ORACLES = {"environment_scores": ENVIRONMENT_SQL, "exposure_caps": _cap_sql(), "capacity_targets": CAPACITY_SQL, "event_exits": EXITS_SQL, "factor_diversity": DIVERSE_SQL}
