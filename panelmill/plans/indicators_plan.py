"""Technical indicators and primitive features of instruments."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import folds as E
from panelmill.functions import windows as W
from panelmill.plans.sql import BARS, with_
from panelmill.sources import bars as B

OVER = "OVER (PARTITION BY code ORDER BY date)"


def over(n, until=0):
    return f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1 + until} PRECEDING AND {until or 'CURRENT'} {'PRECEDING' if until else 'ROW'})"


def _at4(value):
    """Four digits; what lies on the edge goes up, whichever way the sum was rounded."""
    return F.round(value + 1e-7, 4)


def sma_stack(spark, sf_dir):
    rows = B.numbered_bars(spark, sf_dir).withColumns({f"ma{n}": W.sma("close", n) for n in (5, 10, 20, 60)}).withColumn("vma20", W.sma("volume", 20))
    before = W.lag("ma20", 3)
    slope = F.try_divide(F.col("ma20") - before, before) * 100
    return rows.select("code", "date", *[_at4(F.col(f"ma{n}")).alias(f"ma{n}") for n in (5, 10, 20, 60)], _at4(F.col("vma20")).alias("vma20"), _at4(slope).alias("ma20_slope"))


SMA_SQL = with_(BARS) + f"""SELECT code, date, {', '.join(f'round(ma{n} + 1e-7, 4) AS ma{n}' for n in (5, 10, 20, 60))}, round(vma20 + 1e-7, 4) AS vma20,
  round((ma20 - lag(ma20, 3) {OVER}) / nullif(lag(ma20, 3) {OVER}, 0) * 100 + 1e-7, 4) AS ma20_slope FROM (
  SELECT code, date, {', '.join(f'CASE WHEN n >= {n} THEN avg(close) {over(n)} END AS ma{n}' for n in (5, 10, 20, 60))},
    CASE WHEN n >= 20 THEN avg(volume) {over(20)} END AS vma20 FROM b)"""


def bollinger(spark, sf_dir):
    rows = B.numbered_bars(spark, sf_dir).withColumn("mid", W.sma("close", 20)).withColumn("sd", W.full(F.stddev_samp("close").over(W.last_n(20)), 20))
    upper, lower = F.col("mid") + 2 * F.col("sd"), F.col("mid") - 2 * F.col("sd")
    return rows.select("code", "date", F.round(upper, 5).alias("upper"), F.round(lower, 5).alias("lower"), F.round(F.try_divide(upper - lower, F.col("mid")) * 100, 5).alias("width"), F.round(F.try_divide(F.col("close") - lower, upper - lower), 5).alias("percent_b"))


BOLL_SQL = with_(BARS) + f"""SELECT code, date, round(mid + 2 * sd, 5) AS upper, round(mid - 2 * sd, 5) AS lower, round(4 * sd / nullif(mid, 0) * 100, 5) AS width,
  round((close - (mid - 2 * sd)) / nullif(4 * sd, 0), 5) AS percent_b FROM (
  SELECT *, CASE WHEN n >= 20 THEN avg(close) {over(20)} END AS mid, CASE WHEN n >= 20 THEN stddev_samp(close) {over(20)} END AS sd FROM b)"""


def atr_simple(spark, sf_dir):
    rows = B.numbered_bars(spark, sf_dir).withColumn("tr", W.true_range())
    rows = rows.withColumn("atr", W.full(F.avg("tr").over(W.last_n(14)), 14))
    return rows.select("code", "date", "tr", F.round("atr", 6).alias("atr"), F.round(F.col("atr") / F.col("close"), 6).alias("natr"))


TR = f"greatest(high - low, abs(high - lag(close) {OVER}), abs(low - lag(close) {OVER}))"
ATR_SQL = with_(BARS) + f"""SELECT code, date, tr, round(atr, 6) AS atr, round(atr / close, 6) AS natr FROM (
  SELECT *, CASE WHEN n >= 14 THEN avg(tr) {over(14)} END AS atr FROM (SELECT *, {TR} AS tr FROM b))"""


def natr_percentile(spark, sf_dir):
    """Share of the last 120 normalised ranges strictly below the current one; 50 with fewer than 20."""
    rows = B.numbered_bars(spark, sf_dir).withColumn("tr", W.true_range())
    rows = rows.withColumn("natr", F.round(F.avg("tr").over(W.last_n(14)) / F.col("close"), 9))
    seen = rows.withColumn("seen", F.collect_list("natr").over(W.last_n(120)))
    share = F.size(F.filter("seen", lambda x: x < F.col("natr"))) / F.size("seen") * 100
    return seen.select("code", "date", F.round(F.when(F.size("seen") >= 20, share).otherwise(50.0), 6).alias("percentile"))


NATR_SQL = with_(BARS) + f"""SELECT code, date, round(CASE WHEN len(seen) >= 20 THEN len(list_filter(seen, lambda x: x < natr)) / len(seen) * 100 ELSE 50.0::DOUBLE END, 6) AS percentile FROM (
  SELECT *, list(natr) {over(120)} AS seen FROM (SELECT *, round(avg(tr) {over(14)} / close, 9) AS natr FROM (SELECT *, {TR} AS tr FROM b)))"""


def prior_high_low(spark, sf_dir):
    rows = B.numbered_bars(spark, sf_dir)
    return rows.select("code", "date", F.max("high").over(W.last_n(20, 1)).alias("high20"), F.min("low").over(W.last_n(20, 1)).alias("low20"), F.min("low").over(W.last_n(10, 1)).alias("swing_low"), (F.col("close") >= F.max("high").over(W.last_n(20, 1))).alias("breakout"))


PRIOR_SQL = with_(BARS) + f"""SELECT code, date, max(high) {over(20, 1)} AS high20, min(low) {over(20, 1)} AS low20, min(low) {over(10, 1)} AS swing_low, close >= max(high) {over(20, 1)} AS breakout FROM b"""


def volume_price_slope(spark, sf_dir):
    """Least-squares slopes over six bars in closed form: positions 0..5 are fixed, so weights are too."""
    rows = B.numbered_bars(spark, sf_dir)
    slope = lambda c: W.full(sum((5 - 2 * k) * F.lag(c, k).over(W.by_code()) for k in range(6)) / 35, 6)
    price, volume = slope("close"), slope("volume")
    return rows.withColumns({"p": price, "v": volume}).select("code", "date", F.round("p", 6).alias("price_slope"), F.round("v", 6).alias("volume_slope"), ((F.col("p") > 0) & (F.col("v") < 0)).alias("thinning"))


SLOPE_SQL = with_(BARS) + "SELECT code, date, round(p, 6) AS price_slope, round(v, 6) AS volume_slope, p > 0 AND v < 0 AS thinning FROM (SELECT code, date, " + ", ".join(
    "CASE WHEN n >= 6 THEN (" + " + ".join(f"{5 - 2 * k} * {f'lag({c}, {k}) {OVER}' if k else c}" for k in range(6)) + f") / 35 END AS {a}" for c, a in (("close", "p"), ("volume", "v"))
) + " FROM b)"


def macd_last(spark, sf_dir):
    """DIF, DEA and histogram (12/26/9) at each instrument's last bar, with the cross against the bar before."""
    h = E.histories(B.daily_bars(spark, sf_dir), "close").withColumn("c", E.values("close"))
    first = F.element_at("c", 1)
    zero = F.lit(0.0)
    start = F.struct(first.alias("fast"), first.alias("slow"), zero.alias("dif"), zero.alias("dea"), zero.alias("hist"), F.lit(None).cast("double").alias("before"))

    def step(acc, x):
        fast, slow = acc["fast"] * (1 - 2 / 13) + x * (2 / 13), acc["slow"] * (1 - 2 / 27) + x * (2 / 27)
        dif = fast - slow
        dea = acc["dea"] * (1 - 2 / 10) + dif * (2 / 10)
        return F.struct(fast.alias("fast"), slow.alias("slow"), dif.alias("dif"), dea.alias("dea"), (dif - dea).alias("hist"), acc["hist"].alias("before"))

    h = h.withColumn("x", F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), start, step))
    now, before = F.col("x.hist"), F.col("x.before")
    cross = F.when((now > 0) & (before <= 0), "golden").when((now < 0) & (before >= 0), "death").otherwise("none")
    return h.select("code", F.element_at("h", -1)["date"].alias("date"), *[F.round(f"x.{k}", 6).alias(k) for k in ("dif", "dea", "hist")], cross.alias("cross_state"))


def fold_sql(columns: str, first: str, step: str) -> str:
    """A recursive walk over bars: columns carried, their first values and their step (r: state, b: bar)."""
    return with_(BARS, f"w({columns}) AS (SELECT {first} FROM b WHERE n = 1 UNION ALL SELECT {step} FROM w r JOIN b ON b.code = r.code AND b.n = r.n + 1)")


E12, E26, E9 = ("(r.{0} * (1 - 2::DOUBLE / {1}) + {2} * (2::DOUBLE / {1}))".format(a, n, x) for a, n, x in (("e12", 13, "b.close"), ("e26", 27, "b.close"), ("dea", 10, "({0} - {1})")))
MACD_SQL = fold_sql("code, n, date, e12, e26, dea", "code, n, date, close, close, 0::DOUBLE", f"b.code, b.n, b.date, {E12}, {E26}, {E9.format(E12, E26)}") + """
SELECT code, date, round(dif, 6) AS dif, round(dea, 6) AS dea, round(dif - dea, 6) AS hist,
  CASE WHEN dif - dea > 0 AND ph <= 0 THEN 'golden' WHEN dif - dea < 0 AND ph >= 0 THEN 'death' ELSE 'none' END AS cross_state FROM (
  SELECT code, date, n, e12 - e26 AS dif, dea, lag(e12 - e26 - dea) OVER (PARTITION BY code ORDER BY n) AS ph, max(n) OVER (PARTITION BY code) AS m FROM w) WHERE n = m"""


def wilder_atr_last(spark, sf_dir):
    rows = B.daily_bars(spark, sf_dir).withColumn("tr", W.true_range())
    h = E.histories(rows, "tr", "close").where(F.size("h") >= 14)
    return h.select("code", F.element_at("h", -1)["date"].alias("date"), F.round(E.ewm_last(E.values("tr"), 1 / 14), 6).alias("atr14"), F.round(E.ewm_last(E.values("tr"), 1 / 5), 6).alias("atr5"))


WILDER_SQL = fold_sql("code, n, date, close, a14, a5", "code, n, date, close, high - low, high - low", "b.code, b.n, b.date, b.close, " + ", ".join(
    f"r.{a} * (1 - 1::DOUBLE / {n}) + greatest(b.high - b.low, abs(b.high - r.close), abs(b.low - r.close)) * (1::DOUBLE / {n})" for a, n in (("a14", 14), ("a5", 5)))) + """
SELECT code, date, round(a14, 6) AS atr14, round(a5, 6) AS atr5 FROM (SELECT *, max(n) OVER (PARTITION BY code) AS m FROM w) WHERE n = m AND m >= 14"""


def rsi_last(spark, sf_dir):
    h = E.histories(B.daily_bars(spark, sf_dir), "close").where(F.size("h") >= 14).withColumn("d", E.differences(E.values("close")))
    up, down = F.transform("d", lambda x: F.greatest(x, F.lit(0.0))), F.transform("d", lambda x: F.greatest(-x, F.lit(0.0)))
    h = h.withColumns({"up": E.ewm_last(up, 1 / 14), "down": E.ewm_last(down, 1 / 14)})
    return h.select("code", F.element_at("h", -1)["date"].alias("date"), F.round(F.when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("up"), F.col("down")))), 6).alias("rsi14"))


RSI_SQL = fold_sql("code, n, date, close, up, down", "code, n, date, close, 0::DOUBLE, 0::DOUBLE", "b.code, b.n, b.date, b.close, " + ", ".join(
    f"r.{a} * (1 - 1::DOUBLE / 14) + greatest({s}(b.close - r.close), 0) * (1::DOUBLE / 14)" for a, s in (("up", ""), ("down", "-")))) + """
SELECT code, date, round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi14 FROM (SELECT *, max(n) OVER (PARTITION BY code) AS m FROM w) WHERE n = m AND m >= 14"""


def primitives(spark, sf_dir):
    """Numbered bars with the price and volume primitives; 0 where history is short."""
    rows = B.numbered_bars(spark, sf_dir).withColumn("r", F.col("close") / W.lag("close", 1) - 1).withColumn("step", F.abs(F.col("close") - W.lag("close", 1)))
    path, net = F.sum("step").over(W.last_n(20)), F.col("close") - W.lag("close", 20)
    down = F.when(F.col("r") < 0, F.col("r"))
    mean = lambda c, n: F.when(F.col("n") >= n, F.avg(c).over(W.last_n(n)))
    return rows.withColumns(
        {
            "momentum_20": W.log_return("close", 20),
            "momentum_60": W.log_return("close", 60),
            "reversal_5": -W.log_return("close", 5),
            "trend_efficiency_20": F.when((F.col("n") > 20) & (path > 0), W.clip(net / path, -1, 1)).otherwise(0.0),
            "volatility_20": F.when(F.col("n") > 10, F.coalesce(F.stddev_samp("r").over(W.last_n(20)), F.lit(0.0)) * 252**0.5).otherwise(0.0),
            "downside_volatility_60": F.when(F.count(down).over(W.last_n(60)) >= 5, F.stddev_samp(down).over(W.last_n(60)) * 252**0.5).otherwise(0.0),
            "volume_confirmation": F.when(F.col("n") >= 20, W.clip(F.ln(F.greatest(mean("volume", 5), F.lit(1.0)) / F.greatest(mean("volume", 20), F.lit(1.0))), -3, 3)).otherwise(0.0),
            "liquidity_log": F.log1p(F.avg("amount").over(W.last_n(20))),
        }
    )


PRIMITIVES = ["momentum_20", "momentum_60", "reversal_5", "trend_efficiency_20", "volatility_20", "downside_volatility_60", "volume_confirmation", "liquidity_log"]


def primitive_features(spark, sf_dir):
    return primitives(spark, sf_dir).select("code", "date", *[F.round(c, 6).alias(c) for c in PRIMITIVES])


def _log(n):
    return f"CASE WHEN lag(close, {n}) {OVER} > 0 AND close > 0 THEN ln(close / lag(close, {n}) {OVER}) ELSE 0 END"


PRIM = f"""pr AS (SELECT *, {_log(20)} AS momentum_20, {_log(60)} AS momentum_60, -({_log(5)}) AS reversal_5,
  CASE WHEN n > 20 AND sum(step) {over(20)} > 0 THEN greatest(-1, least(1, (close - lag(close, 20) {OVER}) / sum(step) {over(20)})) ELSE 0 END AS trend_efficiency_20,
  CASE WHEN n > 10 THEN coalesce(stddev_samp(r) {over(20)}, 0) * sqrt(252) ELSE 0 END AS volatility_20,
  CASE WHEN count(down) {over(60)} >= 5 THEN stddev_samp(down) {over(60)} * sqrt(252) ELSE 0 END AS downside_volatility_60,
  CASE WHEN n >= 20 THEN greatest(-3, least(3, ln(greatest(avg(volume) {over(5)}, 1) / greatest(avg(volume) {over(20)}, 1)))) ELSE 0 END AS volume_confirmation,
  ln(1 + avg(amount) {over(20)}) AS liquidity_log
  FROM (SELECT *, CASE WHEN r < 0 THEN r END AS down FROM (SELECT *, close / lag(close) {OVER} - 1 AS r, abs(close - lag(close) {OVER}) AS step FROM b)))"""
PRIM_SQL = with_(BARS, PRIM) + f"SELECT code, date, {', '.join(f'round({c}, 6) AS {c}' for c in PRIMITIVES)} FROM pr"


def drawdown_curve(spark, sf_dir):
    rows = B.numbered_bars(spark, sf_dir).withColumn("peak", F.max("close").over(W.by_code().rowsBetween(W.Window.unboundedPreceding, 0)))
    return rows.select("code", "date", F.round(F.col("close") / F.col("peak") - 1, 6).alias("drawdown"), (F.col("close") < F.col("peak")).alias("under_water"))


DRAWDOWN_SQL = with_(BARS) + f"SELECT code, date, round(close / peak - 1, 6) AS drawdown, close < peak AS under_water FROM (SELECT *, max(close) {OVER} AS peak FROM b)"


def longest_underwater(spark, sf_dir):
    """Longest run of sessions below the peak: runs are islands between new peaks."""
    rows = B.numbered_bars(spark, sf_dir).withColumn("peak", F.max("close").over(W.by_code().rowsBetween(W.Window.unboundedPreceding, 0)))
    rows = rows.withColumn("island", F.sum((F.col("close") >= F.col("peak")).cast("int")).over(W.by_code()))
    runs = rows.groupBy("code", "island").agg(F.count_if(F.col("close") < F.col("peak")).alias("length"))
    return runs.groupBy("code").agg(F.max("length").alias("longest"))


UNDERWATER_SQL = with_(BARS) + f"""SELECT code, max(length) AS longest FROM (SELECT code, island, count(*) FILTER (close < peak) AS length FROM (
  SELECT *, sum(CASE WHEN close >= peak THEN 1 ELSE 0 END) {OVER} AS island FROM (SELECT *, max(close) {OVER} AS peak FROM b)) GROUP BY code, island) GROUP BY code"""


def chandelier_stop(spark, sf_dir):
    """High of 22 bars less three simple ranges, ratcheted: while price stays above it the stop never falls."""
    rows = B.numbered_bars(spark, sf_dir).withColumn("tr", W.true_range())
    rows = rows.withColumn("raw", F.round(F.max("high").over(W.last_n(22)) - 3 * F.avg("tr").over(W.last_n(14)), 6))
    h = E.histories(rows, "raw", "close")
    stop = F.aggregate(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), F.element_at("h", 1)["raw"], lambda acc, x: F.when(x["close"] > acc, F.greatest(acc, x["raw"])).otherwise(x["raw"]))
    return h.select("code", F.element_at("h", -1)["date"].alias("date"), stop.alias("stop"))


STOP_SQL = with_(BARS, f"c AS (SELECT *, round(max(high) {over(22)} - 3 * avg(tr) {over(14)}, 6) AS raw FROM (SELECT *, {TR} AS tr FROM b))", """w(code, n, date, stop) AS (
  SELECT code, n, date, raw FROM c WHERE n = 1 UNION ALL SELECT c.code, c.n, c.date, CASE WHEN c.close > r.stop THEN greatest(r.stop, c.raw) ELSE c.raw END FROM w r JOIN c ON c.code = r.code AND c.n = r.n + 1)""") + """
SELECT code, date, stop FROM (SELECT *, max(n) OVER (PARTITION BY code) AS m FROM w) WHERE n = m"""


def histogram_divergence(spark, sf_dir):
    """Divergence of close and MACD histogram over the last 30 bars: a higher high with a lower histogram, a lower low with a higher one, half against half."""
    h = E.histories(B.daily_bars(spark, sf_dir), "close").where(F.size("h") >= 30).withColumn("c", E.values("close"))
    h = h.withColumn("dif", F.zip_with(E.ewm(F.col("c"), 2 / 13), E.ewm(F.col("c"), 2 / 27), lambda a, b: a - b))
    h = h.withColumn("hist", F.zip_with("dif", E.ewm(F.col("dif"), 2 / 10), lambda a, b: F.round(a - b, 9)))
    half = lambda c, at: F.slice(F.slice(c, -30, 30), at, 15)
    for name, at in (("a", 1), ("z", 16)):
        for kind, pick in (("high", F.array_max), ("low", F.array_min)):
            part = half("c", at)
            h = h.withColumn(f"{kind}_{name}", pick(part)).withColumn(f"{kind}_{name}_hist", F.element_at(half("hist", at), F.array_position(part, pick(part)).cast("int")))
    top = (F.col("high_z") > F.col("high_a")) & (F.col("high_z_hist") < F.col("high_a_hist"))
    bottom = (F.col("low_z") < F.col("low_a")) & (F.col("low_z_hist") > F.col("low_a_hist"))
    return h.select("code", F.element_at("h", -1)["date"].alias("date"), top.alias("top_divergence"), bottom.alias("bottom_divergence"))


_HALVES = ", ".join(f"list_{f}({c}) AS {k}_{c}, h_{c}[list_position({c}, list_{f}({c}))] AS {k}_{c}_hist" for c in ("a", "z") for k, f in (("high", "max"), ("low", "min")))
DIVERGENCE_SQL = MACD_SQL[: MACD_SQL.rindex("\nSELECT code, date, round(dif, 6)")] + f""", l AS (SELECT code, max(date) AS date, list(close ORDER BY n) AS c, list(round(e12 - e26 - dea, 9) ORDER BY n) AS h FROM (
    SELECT w.*, b.close, max(w.n) OVER (PARTITION BY w.code) AS m FROM w JOIN b USING (code, n)) WHERE n > m - 30 AND m >= 30 GROUP BY code),
p AS (SELECT code, date, {_HALVES} FROM (SELECT code, date, c[1:15] AS a, c[16:30] AS z, h[1:15] AS h_a, h[16:30] AS h_z FROM l))
SELECT code, date, high_z > high_a AND high_z_hist < high_a_hist AS top_divergence, low_z < low_a AND low_z_hist > low_a_hist AS bottom_divergence FROM p"""

QUERIES = {
    f.__name__: f
    for f in (sma_stack, bollinger, atr_simple, natr_percentile, prior_high_low, volume_price_slope, macd_last, wilder_atr_last, rsi_last, primitive_features, drawdown_curve, longest_underwater, chandelier_stop, histogram_divergence)
}
ORACLES = dict(zip(QUERIES, (SMA_SQL, BOLL_SQL, ATR_SQL, NATR_SQL, PRIOR_SQL, SLOPE_SQL, MACD_SQL, WILDER_SQL, RSI_SQL, PRIM_SQL, DRAWDOWN_SQL, UNDERWATER_SQL, STOP_SQL, DIVERGENCE_SQL), strict=True))
