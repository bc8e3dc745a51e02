"""Bars, periods, calendars, alignment of price bases and manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators import calendar as C
from panelmill.plans.sql import BARS, SESSIONS, with_
from panelmill.sources import bars as B

AS_OF = "2001-06-20"
ROLLED = ["code", "period", "date", "open", "high", "low", "close", "volume"]


def bars_daily(spark, sf_dir):
    return B.daily_bars(spark, sf_dir)


def _period(unit):
    return lambda spark, sf_dir: C.confirmed(B.daily_bars(spark, sf_dir), B.sessions(spark, sf_dir), unit, AS_OF).select(*ROLLED)


def _period_sql(unit, sure=True):
    ends = f"JOIN (SELECT date_trunc('{unit}', date)::DATE AS period, max(date) AS e FROM cal GROUP BY 1) USING (period) WHERE e <= DATE '{AS_OF}'" if sure else ""
    until = f"WHERE date <= DATE '{AS_OF}'" if sure else ""
    return with_(BARS, SESSIONS) + f"""SELECT {', '.join(ROLLED)} FROM (
      SELECT code, date_trunc('{unit}', date)::DATE AS period, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, date) AS close, sum(volume) AS volume FROM bars b0 {until} GROUP BY 1, 2) {ends}"""


def bars_weekly_preview(spark, sf_dir):
    return C.roll_up(B.daily_bars(spark, sf_dir), "week").select(*ROLLED)


def calendar_sessions(spark, sf_dir):
    numbered = C.session_number(B.sessions(spark, sf_dir))
    w = Window.orderBy("date")
    return numbered.select("date", "session", F.lead("date").over(w).alias("next_session"), F.weekofyear("date").alias("iso_week"), F.extract(F.lit("YEAROFWEEK"), F.col("date")).cast("int").alias("iso_year"), F.pmod(F.weekofyear("date"), F.lit(2)).alias("sleeve"))


CALENDAR_SQL = with_(SESSIONS) + """SELECT date, row_number() OVER (ORDER BY date) AS session, lead(date) OVER (ORDER BY date) AS next_session,
  CAST(weekofyear(date) AS INT) AS iso_week, CAST(isoyear(date) AS INT) AS iso_year, CAST(weekofyear(date) % 2 AS INT) AS sleeve FROM cal"""


def _bases(spark, sf_dir):
    """The bars in a second basis: a step factor by year, with two sessions a month missing on either side."""
    raw = B.daily_bars(spark, sf_dir)
    factor = F.lit(1.0) + (F.year("date") - 1995) * F.lit(0.2)
    adjusted = raw.where(F.dayofmonth("date") != 13).select("code", "date", *[(F.col(c) * factor).alias(f"{c}_adj") for c in ("open", "high", "low", "close")])
    return raw.where(F.dayofmonth("date") != 27), adjusted


def _aligned(spark, sf_dir):
    raw, adjusted = _bases(spark, sf_dir)
    both = raw.join(adjusted, ["code", "date"]).withColumn("factor", F.col("close_adj") / F.col("close"))
    return both.withColumn("change", F.abs(F.col("factor") / F.lag("factor").over(B.by_code()) - 1))


def basis_alignment_quality(spark, sf_dir):
    raw, adjusted = _bases(spark, sf_dir)
    outer = raw.select("code", "date", "close").join(adjusted.select("code", "date", "close_adj"), ["code", "date"], "full_outer")
    missing = outer.groupBy("code").agg(F.count_if(F.col("close").isNull()).alias("only_adjusted"), F.count_if(F.col("close_adj").isNull()).alias("only_raw"))
    sane = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("low") > 0)
    quality = _aligned(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("aligned"), F.count_if(F.col("change") > 0.15).alias("jumps"), F.count_if(~sane).alias("insane"))
    status = F.when((F.col("aligned") < 50) | (F.col("insane") > 0), "BLOCKED").when((F.col("jumps") > 0) | (F.col("only_adjusted") + F.col("only_raw") > 0), "DEGRADED").otherwise("VALID")
    return quality.join(missing, "code").withColumn("status", status)


BASES = """raw AS (SELECT * FROM bars WHERE day(date) <> 27),
adj AS (SELECT code, date, close * (1.0::DOUBLE + (year(date) - 1995) * 0.2::DOUBLE) AS close_adj FROM bars WHERE day(date) <> 13),
al AS (SELECT *, abs(factor / lag(factor) OVER (PARTITION BY code ORDER BY date) - 1) AS change FROM (
  SELECT raw.*, close_adj, close_adj / close AS factor FROM raw JOIN adj USING (code, date)))"""
ALIGN_SQL = with_(BARS, BASES) + """SELECT *, CASE WHEN aligned < 50 OR insane > 0 THEN 'BLOCKED' WHEN jumps > 0 OR only_adjusted + only_raw > 0 THEN 'DEGRADED' ELSE 'VALID' END AS status FROM (
  SELECT code, count(*) AS aligned, count(*) FILTER (change > 0.15) AS jumps,
    count(*) FILTER (NOT (high >= greatest(open, close) AND low <= least(open, close) AND low > 0)) AS insane FROM al GROUP BY code) JOIN (
  SELECT code, count(*) FILTER (close IS NULL) AS only_adjusted, count(*) FILTER (close_adj IS NULL) AS only_raw
  FROM (SELECT code, date, close FROM raw) FULL JOIN adj USING (code, date) GROUP BY code) USING (code)"""


def adjustment_crossed(spark, sf_dir):
    ahead = B.by_code().rowsBetween(0, 21)
    rows = _aligned(spark, sf_dir).withColumn("step", F.coalesce(F.col("change") > 0.005, F.lit(False)))
    return rows.select("code", "date", F.bool_or("step").over(ahead).alias("crossed"))


CROSSED_SQL = with_(BARS, BASES) + "SELECT code, date, bool_or(coalesce(change > 0.005, false)) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 21 FOLLOWING) AS crossed FROM al"


def data_manifest(spark, sf_dir):
    """One row per required series: reasons, and whether the whole set may be used (one common date, none missing or stale)."""
    required = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("code")).distinct()
    last = B.session_totals(spark, sf_dir).groupBy("code").agg(F.max("date").alias("last_date"), F.count(F.lit(1)).alias("bars"))
    expected = B.sessions(spark, sf_dir).agg(F.max("date")).scalar()
    rows = required.join(last, "code", "left").withColumn("expected_date", expected)
    lag = C.weekdays_between(F.col("last_date"), F.col("expected_date"))
    reasons = F.array_compact(F.array(F.when(F.col("last_date").isNull(), "MISSING"), F.when(F.col("bars") < 275, "SHORT"), F.when(lag > 2, "STALE")))
    rows = rows.select("code", "last_date", F.coalesce("bars", F.lit(0)).alias("bars"), lag.alias("session_lag"), F.array_join(reasons, ",").alias("reasons"))
    approved = rows.agg(F.bool_and((F.col("reasons") == "") & F.col("last_date").isNotNull()) & (F.count_distinct("last_date") == 1)).scalar()
    return rows.withColumn("approved", approved)


MANIFEST_SQL = with_(BARS, SESSIONS) + """, r AS (
  SELECT code, last_date, coalesce(bars, 0) AS bars, coalesce((SELECT count(*) FROM cal WHERE date > last_date) , 999) AS lag0 FROM (SELECT DISTINCT p_brand AS code FROM part)
  LEFT JOIN (SELECT code, max(date) AS last_date, count(*) AS bars FROM bars GROUP BY code) USING (code)),
m AS (SELECT code, last_date, bars, CASE WHEN last_date IS NULL THEN 999 ELSE lag0 END AS session_lag FROM r),
k AS (SELECT *, concat_ws(',', CASE WHEN last_date IS NULL THEN 'MISSING' END, CASE WHEN bars < 275 AND last_date IS NOT NULL THEN 'SHORT' END, CASE WHEN session_lag > 2 THEN 'STALE' END) AS reasons FROM m)
SELECT code, last_date, bars, session_lag, reasons, (SELECT bool_and(reasons = '' AND last_date IS NOT NULL) AND count(DISTINCT last_date) = 1 FROM k) AS approved FROM k""".replace("\n, r AS", ", r AS")


def session_lag(spark, sf_dir):
    last = B.session_totals(spark, sf_dir).groupBy("code").agg(F.max("date").alias("last_date"))
    end = F.lit("2001-12-03").cast("date")
    return last.select("code", "last_date", C.weekdays_between(F.col("last_date"), end).alias("weekdays"), (C.weekdays_between(F.col("last_date"), end) > 2).alias("stale"))


LAG_SQL = with_(BARS) + """SELECT code, last_date, (SELECT count(*) FROM generate_series(last_date + 1, DATE '2001-12-03', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6) AS weekdays,
  (SELECT count(*) FROM generate_series(last_date + 1, DATE '2001-12-03', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6) > 2 AS stale
  FROM (SELECT code, max(date) AS last_date FROM bars GROUP BY code)"""

#: Ordered rules: the first that matches wins.
GROUP_RULES = [("ECONOMY", "value"), ("PROMO", "growth"), ("STANDARD", "core"), ("BRASS", "metal"), ("STEEL", "metal")]


def industry_groups(spark, sf_dir):
    rule = F.lit("other")
    for word, group in reversed(GROUP_RULES):
        rule = F.when(F.col("p_type").contains(word), group).otherwise(rule)
    parts = B.table(spark, sf_dir, "part")
    prefix = F.when(F.col("p_brand").endswith("1"), "sh").when(F.col("p_brand").endswith("2"), "sz").otherwise("bj")
    return parts.select(rule.alias("industry_group"), prefix.alias("market")).groupBy("industry_group", "market").agg(F.count(F.lit(1)).alias("members"))


GROUPS_SQL = "SELECT CASE " + " ".join(f"WHEN contains(p_type, '{w}') THEN '{g}'" for w, g in GROUP_RULES) + """ ELSE 'other' END AS industry_group,
  CASE WHEN p_brand LIKE '%1' THEN 'sh' WHEN p_brand LIKE '%2' THEN 'sz' ELSE 'bj' END AS market, count(*) AS members FROM part GROUP BY 1, 2"""


def provider_crosscheck(spark, sf_dir):
    """Last five common sessions of two providers: largest and median relative difference and the verdict."""
    one = B.daily_bars(spark, sf_dir).select("code", "date", "close")
    two = one.select("code", "date", (F.col("close") * (1 + F.dayofmonth("date") * F.lit(0.0004))).alias("other"))
    both = one.join(two, ["code", "date"]).withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date"))))
    gap = F.abs(F.col("other") / F.col("close") - 1)
    return both.where("rn <= 5").groupBy("code").agg(F.round(F.max(gap), 6).alias("largest"), F.round(F.percentile(gap, 0.5), 6).alias("middle")).withColumn("accepted", (F.col("largest") <= 0.01) & (F.col("middle") <= 0.005))


CROSSCHECK_SQL = with_(BARS) + """SELECT *, largest <= 0.01 AND middle <= 0.005 AS accepted FROM (
  SELECT code, round(max(gap), 6) AS largest, round(quantile_cont(gap, 0.5), 6) AS middle FROM (
    SELECT code, abs(close * (1 + day(date) * 0.0004::DOUBLE) / close - 1) AS gap, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 5 GROUP BY code)"""


def score_history(spark, sf_dir):
    """The last 30 daily scores of each instrument (a window of rows, not of the input)."""
    rn = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    return B.daily_bars(spark, sf_dir).withColumn("rn", rn).where("rn <= 30").select("code", "date", F.col("close").alias("score"))


HISTORY_SQL = with_(BARS) + "SELECT code, date, close AS score FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 30"


def signal_dates(spark, sf_dir):
    """Every fifth bar that has 252 bars before it and 21 behind it."""
    rows = B.numbered_bars(spark, sf_dir).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("code")) - F.col("n"))
    return rows.where("n >= 253 AND left >= 21 AND (n - 253) % 5 = 0").select("code", "date", "n")


SIGNAL_DATES_SQL = with_(BARS) + "SELECT code, date, n FROM (SELECT code, date, n, count(*) OVER (PARTITION BY code) - n AS l FROM b) WHERE n >= 253 AND l >= 21 AND (n - 253) % 5 = 0"


def asof_price_lookup(spark, sf_dir):
    """Price at the date ten days behind each weekly bar: that session's close, else the last one before it."""
    bars = B.daily_bars(spark, sf_dir)
    probes = C.roll_up(bars, "week").select("code", F.date_add("date", 10).alias("date"))
    return C.as_of(probes, bars, "close")


ASOF_SQL = with_(BARS) + "SELECT p.code, p.date, bars.close FROM (SELECT code, max(date) + 10 AS date FROM bars GROUP BY code, date_trunc('week', date)) p ASOF LEFT JOIN bars ON p.code = bars.code AND p.date >= bars.date"

QUERIES = {
    "bars_daily": bars_daily,
    "bars_weekly_confirmed": _period("week"),
    "bars_monthly_confirmed": _period("month"),
    "bars_weekly_preview": bars_weekly_preview,
    "calendar_sessions": calendar_sessions,
    "basis_alignment_quality": basis_alignment_quality,
    "adjustment_crossed": adjustment_crossed,
    "data_manifest": data_manifest,
    "session_lag": session_lag,
    "industry_groups": industry_groups,
    "provider_crosscheck": provider_crosscheck,
    "score_history": score_history,
    "signal_dates": signal_dates,
    "asof_price_lookup": asof_price_lookup,
}
ORACLES = {
    "bars_daily": with_(BARS) + "SELECT * FROM bars",
    "bars_weekly_confirmed": _period_sql("week"),
    "bars_monthly_confirmed": _period_sql("month"),
    "bars_weekly_preview": _period_sql("week", False),
    "calendar_sessions": CALENDAR_SQL,
    "basis_alignment_quality": ALIGN_SQL,
    "adjustment_crossed": CROSSED_SQL,
    "data_manifest": MANIFEST_SQL,
    "session_lag": LAG_SQL,
    "industry_groups": GROUPS_SQL,
    "provider_crosscheck": CROSSCHECK_SQL,
    "score_history": HISTORY_SQL,
    "signal_dates": SIGNAL_DATES_SQL,
    "asof_price_lookup": ASOF_SQL,
}
