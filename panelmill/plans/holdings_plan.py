"""Held names under rank buffers, the buffer that development would choose, and its acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.operators import holdings as H
from panelmill.operators import portfolio as P
from panelmill.operators import rotation as R
from panelmill.plans import crosssection_plan as X
from panelmill.plans.research_plan import SUMMARY
from panelmill.plans.sql import with_

NAMES, BUFFERS, SLEEVES = 3, (0, 1, 2, 3), 2
#: The tables' prices jump, so returns are scaled as in the other portfolio queries.
SCALE = 1000


def _held(spark, sf_dir):
    ranked = R.top_by_group(R.rotation_score(X.panel(spark, sf_dir)), NAMES + max(BUFFERS)).select("date", "rank", "code")
    return H.held(ranked, NAMES, BUFFERS, SLEEVES)


def rotation_held(spark, sf_dir):
    """Three names a week in two sleeves that take turns, under buffers of 0 to 3."""
    return _held(spark, sf_dir)


HELD_CTES = f"""dt AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM tp)),
ls AS (SELECT buffer, t, date, list(code ORDER BY rank) AS names FROM tp JOIN dt USING (date), (SELECT unnest({list(BUFFERS)}) AS buffer) WHERE rank <= {NAMES} + buffer GROUP BY 1, 2, 3),
hd(buffer, t, date, held, stays) AS (
  SELECT buffer, t, date, names[1:{NAMES}], 0::BIGINT FROM ls WHERE t <= {SLEEVES}
  UNION ALL SELECT buffer, t, date, list_concat(kept, list_filter(names, lambda x: NOT list_contains(kept, x)))[1:{NAMES}], len(kept) FROM (
    SELECT ls.*, list_filter(hd.held, lambda x: list_contains(names, x)) AS kept FROM hd JOIN ls ON ls.buffer = hd.buffer AND ls.t = hd.t + {SLEEVES})),
hl AS (SELECT buffer, CAST((t - 1) % {SLEEVES} AS INT) AS sleeve, date, CAST(slot AS INT) AS slot, held[slot] AS code, slot <= stays AS incumbent FROM (SELECT *, unnest(range(1, len(held) + 1)) AS slot FROM hd))"""
HELD_SQL = with_(*X.BASE, X.ROT, X.TOP, HELD_CTES) + "SELECT CAST(buffer AS INT) AS buffer, sleeve, date, slot, code, incumbent FROM hl"


def _paths(spark, sf_dir):
    rows = X.panel(spark, sf_dir).where("forward IS NOT NULL")
    market = rows.groupBy("date").agg(F.avg("forward").alias("rb"))
    return H.paths(_held(spark, sf_dir), rows.select("date", "code", F.col("forward").alias("r")), market)


def _lanes(spark, sf_dir):
    """code (buffer and range), date, r, rb, fresh: development before the last three years, audit since."""
    rows = _paths(spark, sf_dir)
    start = F.make_date(F.year(rows.agg(F.max("date").alias("z")).scalar()) - H.AUDIT_YEARS + 1, F.lit(1), F.lit(1))
    part = F.when(F.col("date") < start, "dev").otherwise("audit")
    return rows.select(F.concat(F.col("buffer").cast("string"), F.lit("/"), part).alias("code"), "date", (F.col("r") / SCALE).alias("r"), (F.col("rb") / SCALE).alias("rb"), "fresh")


CHOSEN = ["information_ratio", "excess_return", "max_drawdown"]


def buffer_choice(spark, sf_dir):
    """Development metrics of each buffer, the one chosen by them, and its metrics in the years kept for the audit."""
    lanes = _lanes(spark, sf_dir).persist()
    found = P.summary(lanes.select("code", "date", "r", "rb")).join(lanes.groupBy("code").agg(F.round(F.avg("fresh"), 6).alias("turnover")), "code")
    found = found.withColumns({"buffer": F.split("code", "/")[0].cast("int"), "part": F.split("code", "/")[1]}).select("buffer", "part", *CHOSEN, "turnover")
    chosen = H.choose_buffer(found.where("part = 'dev'").drop("part"))
    audit = found.where("part = 'audit'").select(F.col("buffer"), F.lit(True).alias("selected"), *[F.col(c).alias(f"audit_{c}") for c in CHOSEN])
    return chosen.join(audit, ["buffer", "selected"], "left").select("buffer", *CHOSEN, "turnover", "eligible", "selected", *[f"audit_{c}" for c in CHOSEN])


LANES = f"""mk AS (SELECT date, avg(forward) AS rb FROM pan WHERE forward IS NOT NULL GROUP BY 1),
pa0 AS (SELECT hl.buffer, hl.date, avg(coalesce(pan.forward, 0)) AS r, avg(CASE WHEN incumbent THEN 0.0::DOUBLE ELSE 1 END) AS fresh FROM hl LEFT JOIN pan ON pan.date = hl.date AND pan.code = hl.code GROUP BY 1, 2),
pa1 AS (SELECT *, make_date(year(max(date) OVER ())::INT - {H.AUDIT_YEARS} + 1, 1, 1) AS start FROM pa0 JOIN mk USING (date)),
wr AS (SELECT buffer || '/' || CASE WHEN date < start THEN 'dev' ELSE 'audit' END AS code, date, r, rb, fresh FROM pa1),
{SUMMARY},
mt AS (SELECT CAST(split_part(code, '/', 1) AS INT) AS buffer, split_part(code, '/', 2) AS part, {', '.join(CHOSEN)}, turnover FROM pf JOIN (SELECT code, round(avg(fresh), 6) AS turnover FROM wr GROUP BY 1) USING (code))"""
_ok = f"coalesce(excess_return > 0 AND information_ratio > 0 AND max_drawdown <= {H.MOST_DRAWDOWN}, false)"
CHOICE_SQL = with_(*X.BASE, X.ROT, X.TOP, HELD_CTES, LANES) + f"""SELECT c.*, {', '.join(f'a.{m} AS audit_{m}' for m in CHOSEN)} FROM (
  SELECT *, row_number() OVER (ORDER BY eligible DESC, information_ratio DESC NULLS LAST, excess_return DESC NULLS LAST, turnover NULLS LAST, buffer) = 1 AS selected FROM (SELECT buffer, {', '.join(CHOSEN)}, turnover, {_ok} AS eligible FROM mt WHERE part = 'dev')) c
LEFT JOIN (SELECT * FROM mt WHERE part = 'audit') a ON a.buffer = c.buffer AND c.selected"""

#: What the gates read of a path, beside the metrics above.
READ = ["excess_return", "information_ratio", "max_drawdown", "positive_years", "years", "rolling", "rolling_positive", "rolling_worst", "relative_drawdown", "under_water"]


def _both(spark, sf_dir):
    """One row a buffer: metrics of the whole path and, as recent_*, of the audit years."""
    paths, lanes = _paths(spark, sf_dir), _lanes(spark, sf_dir).where("code LIKE '%/audit'").drop("fresh")
    whole = paths.select(F.concat(F.col("buffer").cast("string"), F.lit("/all")).alias("code"), "date", (F.col("r") / SCALE).alias("r"), (F.col("rb") / SCALE).alias("rb"))
    rows = whole.unionByName(lanes).persist()
    found = P.summary(rows).join(H.path_metrics(rows), "code").withColumns({"buffer": F.split("code", "/")[0].cast("int"), "part": F.split("code", "/")[1]})
    recent = found.where("part = 'audit'").select("buffer", *[F.col(c).alias(f"recent_{c}") for c in READ])
    return found.where("part = 'all'").select("buffer", *READ, "benchmark_drawdown").join(recent, "buffer", "left")


def rotation_gates(spark, sf_dir):
    """The 21 gates for each buffer's path. Every name is held at its size, so capacity is filled by construction."""
    rows = _both(spark, sf_dir).withColumns({"capacity_fill": F.lit(1.0), "recent_capacity_fill": F.lit(1.0)})
    return H.rotation_gates(rows).select("buffer", *READ[4:], *[f"recent_{c}" for c in READ[4:]], "failed", "approved")


_WHOLE = LANES[: LANES.index("wr AS (")] + "wr AS (SELECT buffer || '/all' AS code, date, r, rb FROM pa1 UNION ALL SELECT buffer || '/audit', date, r, rb FROM pa1 WHERE date >= start),\n" + SUMMARY
GATES_CTES = _WHOLE + f""",
m0 AS (SELECT *, row_number() OVER w AS k, CASE WHEN row_number() OVER w >= {H.ROLLING} THEN round(exp(sum(ln(1 + r)) OVER (w ROWS BETWEEN {H.ROLLING - 1} PRECEDING AND CURRENT ROW)) - exp(sum(ln(1 + rb)) OVER (w ROWS BETWEEN {H.ROLLING - 1} PRECEDING AND CURRENT ROW)), 9) END AS e,
  round(exp(sum(ln(1 + r) - ln(1 + rb)) OVER w), 9) AS rel FROM (SELECT code, date, r / {SCALE} AS r, rb / {SCALE} AS rb FROM wr) WINDOW w AS (PARTITION BY code ORDER BY date)),
m1 AS (SELECT *, greatest(1.0::DOUBLE, max(rel) OVER (PARTITION BY code ORDER BY date)) AS peak FROM m0),
m2 AS (SELECT *, sum(CASE WHEN rel >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY date) AS island FROM m1),
m3 AS (SELECT code, max(run) AS under_water FROM (SELECT code, island, count(*) FILTER (rel < peak) AS run FROM m2 GROUP BY 1, 2) GROUP BY 1),
m4 AS (SELECT code, count(e) AS rolling, round(avg(CASE WHEN e > 0 THEN 1.0::DOUBLE WHEN e IS NOT NULL THEN 0 END), 6) AS rolling_positive, round(min(e), 6) AS rolling_worst, round(max(1 - rel / peak), 6) AS relative_drawdown, count(DISTINCT year(date)) AS years FROM m2 GROUP BY 1),
m5 AS (SELECT CAST(split_part(code, '/', 1) AS INT) AS buffer, split_part(code, '/', 2) AS part, pf.*, m3.under_water, m4.* EXCLUDE (code) FROM pf JOIN m3 USING (code) JOIN m4 USING (code)),
m6 AS (SELECT a.buffer, {', '.join(f'a.{c}' for c in READ)}, a.benchmark_drawdown, {', '.join(f'z.{c} AS recent_{c}' for c in READ)}, 1.0::DOUBLE AS capacity_fill, 1.0::DOUBLE AS recent_capacity_fill FROM (SELECT * FROM m5 WHERE part = 'all') a LEFT JOIN (SELECT * FROM m5 WHERE part = 'audit') z ON z.buffer = a.buffer)"""
_failed = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END" for name, rule in H.GATES) + ")"
GATES_SQL = with_(*X.BASE, X.ROT, X.TOP, HELD_CTES, GATES_CTES) + f"SELECT buffer, {', '.join(READ[4:])}, {', '.join(f'recent_{c}' for c in READ[4:])}, {_failed} AS failed, {_failed} = '' AS approved FROM m6"

QUERIES = {f.__name__: f for f in (rotation_held, buffer_choice, rotation_gates)}
ORACLES = {"rotation_held": HELD_SQL, "buffer_choice": CHOICE_SQL, "rotation_gates": GATES_SQL}
