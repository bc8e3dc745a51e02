"""States of entry signals, and which factors an approval would take."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.operators import signals as S
from panelmill.plans import bars_plan as P
from panelmill.plans import crosssection_plan as X
from panelmill.plans import factors_plan as T
from panelmill.plans import labels_plan as L
from panelmill.plans import research_plan as R
from panelmill.sources import cuts

OUT = ["code", "state", "reasons", "channel", "trend", "mainline", "baseline", *S.FEATURES]
#: A calibration counts as approved from so many labelled rows on.
LEAST_LABELS = 30


def _at6(value):
    return F.round(value + 1e-9, 6)


@cuts.sharing
def signal_states(spark, sf_dir):
    """The state of every instrument's signal at its last bar, from its setup, trends, strength, labels and the market's policy."""
    labels = L.forward_labels(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("labels"), _at6(F.avg("early_stop")).alias("early_stop"), _at6(F.avg("excess_10d")).alias("excess"))
    strength = X.relative_strength(spark, sf_dir).select("code", "has_120", F.col("score").alias("relative_strength"))
    market = X.market_policy(spark, sf_dir).agg(F.max_by("permission", "date").alias("permission"), F.max_by("score", "date").alias("market_score"))  # one row
    picks = X.rotation_top3(spark, sf_dir)
    targets = picks.groupBy("code").agg(F.max("date").alias("picked")).join(F.broadcast(picks.agg(F.max("date").alias("end"))), F.col("picked") == F.col("end")).select("code", F.lit(True).alias("target"))
    rows = T.setup_and_risk(spark, sf_dir)
    for other in (T.priority_score(spark, sf_dir), T.weekly_trend(spark, sf_dir), T.monthly_trend(spark, sf_dir).withColumn("history_ok", F.lit(True)), strength, labels, targets, P.basis_alignment_quality(spark, sf_dir).select("code", F.col("status").alias("quality"))):
        rows = rows.join(other, "code", "left")
    unknown = {k: F.lit(None).cast("double") for k in ("win", "early_stop_max", "priority_min", "setup_min", "adaptive_score")}
    rows = rows.join(F.broadcast(market)).withColumns({"approved": F.col("labels") >= LEAST_LABELS, **unknown})
    found = S.signal_states(rows)
    return found.select(*[F.round(c, 6).alias(c) if c in S.FEATURES else c for c in OUT])


def _states_sql():
    part = lambda query, columns: f"(SELECT {columns} FROM ({ {**T.ORACLES, **X.ORACLES, **P.ORACLES, **L.ORACLES}[query] }))"
    rows = f"""WITH s0 AS (SELECT *, labels >= {LEAST_LABELS} AS approved, NULL::DOUBLE AS win, NULL::DOUBLE AS early_stop_max, NULL::DOUBLE AS priority_min, NULL::DOUBLE AS setup_min, NULL::DOUBLE AS adaptive_score
FROM {part('setup_and_risk', '*')} LEFT JOIN {part('priority_score', '*')} USING (code) LEFT JOIN {part('weekly_trend', '*')} USING (code) LEFT JOIN {part('monthly_trend', '*, true AS history_ok')} USING (code)
LEFT JOIN {part('relative_strength', 'code, has_120, score AS relative_strength')} USING (code)
LEFT JOIN (SELECT code, count(*) AS labels, round(avg(early_stop) + 1e-9, 6) AS early_stop, round(avg(excess_10d) + 1e-9, 6) AS excess FROM {part('forward_labels', '*')} GROUP BY code) USING (code)
LEFT JOIN (SELECT code, true AS target FROM (SELECT code, date, max(date) OVER () AS e FROM {part('rotation_top3', '*')}) WHERE date = e) USING (code)
LEFT JOIN {part('basis_alignment_quality', 'code, status AS quality')} USING (code)
CROSS JOIN (SELECT arg_max(permission, date) AS permission, arg_max(score, date) AS market_score FROM {part('market_policy', '*')}))"""
    for k, step in enumerate(S.steps()):
        rows += f",\ns{k + 1} AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f") FROM s{k})" if k == 0 else f",\ns{k + 1} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f" FROM s{k})"
    return rows + "\nSELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in S.FEATURES else c for c in OUT) + f" FROM s{len(S.steps())}"


def factor_approval(spark, sf_dir):
    """Whether each factor, as a set of its own beside the others that stay, would be approved, and why not."""
    found = R.factor_metrics(spark, sf_dir)
    stay = found.agg(F.count_if(F.col("status") != "RETIRED").alias("factors"))  # one row
    rows = found.select("factor", "status", "ic_mean", "ic_ir", "turnover", F.col("observations").alias("ic_observations"), F.col("recent_mean").alias("recent_ic_mean")).join(F.broadcast(stay))
    rows = rows.withColumns({"same_policy": F.lit(True), "changed": F.col("turnover") > 0.5, "unseen_dates": F.col("ic_observations"), "selected": F.col("status") == "ACTIVE"})
    return S.approval(rows).select("factor", "reasons", "approved")


QUERIES = {f.__name__: f for f in (signal_states, factor_approval)}
ORACLES = {
    "signal_states": _states_sql(),
    "factor_approval": f"""SELECT factor, {S.reason_list(S.APPROVAL)} AS reasons, {S.reason_list(S.APPROVAL)} = '' AS approved FROM (
  SELECT factor, status, ic_mean, ic_ir, turnover, observations AS ic_observations, recent_mean AS recent_ic_mean, count(*) FILTER (status <> 'RETIRED') OVER () AS factors, true AS same_policy, turnover > 0.5 AS changed, observations AS unseen_dates, status = 'ACTIVE' AS selected
  FROM ({R.ORACLES['factor_metrics']}))""",
}
