"""Choice between models, calibrations that are due, readiness for promotion, predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators import governance as G
from panelmill.plans import crosssection_plan as X
from panelmill.plans import factors_plan as T
from panelmill.plans import research_plan as R
from panelmill.plans import signals_plan as S
from panelmill.plans.sql import with_
from panelmill.sources import bars as B


def model_choices(spark, sf_dir):
    """Each instrument's portfolio as a candidate against that of the instrument before it, the incumbent."""
    found = R.portfolio_summary(spark, sf_dir)
    w = Window.orderBy("code")  # one row an instrument
    pairs = found.select("code", *[F.col(m).alias(f"c_{m}") for m, _ in G.COMPARED], *[F.lag(m).over(w).alias(f"i_{m}") for m, _ in G.COMPARED], F.lag("periods").over(w).cast("string").alias("i_fingerprint"), F.greatest("periods", F.lag("periods").over(w)).cast("string").alias("fingerprint"))
    return G.choose_models(pairs.withColumns({k: F.coalesce(k, F.lit("")) for k in ("fingerprint", "i_fingerprint")})).select("code", "reason", "selected")


_LAG = "lag({0}) OVER (ORDER BY code)".format
CHOICES_SQL = f"""SELECT code, reason, selected FROM (SELECT *, {', '.join(f'{e} AS {k}' for k, e in G.choice_sql().items())} FROM (
  SELECT code, {', '.join(f'{m} AS c_{m}, {_LAG(m)} AS i_{m}' for m, _ in G.COMPARED)}, coalesce({_LAG('periods')}::VARCHAR, '') AS i_fingerprint, coalesce(greatest(periods, {_LAG('periods')})::VARCHAR, '') AS fingerprint
  FROM ({R.ORACLES['portfolio_summary']})))"""

NOW = "1998-06-01"


def calibration_due(spark, sf_dir):
    """Orders as models (order date: generated; first and last shipment: what it was trained on): how many are due, by reasons."""
    lines = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("cutoff"), F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("top"))
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("made"), "o_orderpriority").join(lines, "o_orderkey", "left")
    age = F.datediff(F.lit(NOW).cast("date"), "made")
    models = rows.select((F.col("o_orderkey") % 7 != 0).alias("present"), age.alias("age"), (age + (F.col("o_orderkey") % 60).cast("int")).alias("lag"), "cutoff", F.col("n").cast("string").alias("expected"), F.col("top").cast("string").alias("found"), F.substring("o_orderpriority", 1, 1).alias("policy"), F.lit("1").alias("current_policy"))
    return G.calibration_due(models).groupBy("due").agg(F.count(F.lit(1)).alias("models"))


DUE_SQL = f"""SELECT {G.reason_list(G.DUE)} AS due, count(*) AS models FROM (
  SELECT o_orderkey % 7 <> 0 AS present, date_diff('day', made, DATE '{NOW}') AS age, date_diff('day', made, DATE '{NOW}') + o_orderkey % 60 AS lag, cutoff, n::VARCHAR AS expected, top::VARCHAR AS found, substr(o_orderpriority, 1, 1) AS policy, '1' AS current_policy
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS made, o_orderpriority FROM orders) LEFT JOIN (SELECT l_orderkey AS o_orderkey, max(CAST(l_shipdate AS DATE)) AS cutoff, count(*) AS n, max(l_linenumber) AS top FROM lineitem GROUP BY 1) USING (o_orderkey)) GROUP BY 1"""


def promotion_readiness(spark, sf_dir):
    """How far each factor's approval is from live use; names of even length stand for registries that are not the live ones."""
    found = S.factor_approval(spark, sf_dir).withColumns({"identity_match": F.length("factor") % 2 == 1, "live_ok": F.lit(True)})
    return G.readiness(found).select("factor", "readiness", "next_action")


READINESS_SQL = f"SELECT factor, {G.READY} AS readiness, {G.NEXT} AS next_action FROM (SELECT *, length(factor) % 2 = 1 AS identity_match, true AS live_ok FROM ({S.ORACLES['factor_approval']}))"

#: A model with the shape of a fitted one.
MODEL = {
    "features": ["momentum_20", "trend_efficiency_20", "reversal_5"],
    "mean": [0.01, 0.1, 0.0],
    "scale": [0.2, 0.3, 0.0],
    "early_stop": [-1.0, -0.4, -0.3, 0.2],
    "win": [0.1, 0.5, 0.2, -0.1],
    "excess": [0.002, 0.01, 0.004, -0.003],
    "samples": 64,
}


def predicted_heads(spark, sf_dir):
    """Chance of an early stop, chance of a gain and expected excess of every row of the panel under one model."""
    rows = X.panel(spark, sf_dir).select("code", "date", *MODEL["features"])
    return G.predict(rows, MODEL).select("code", "date", "early_stop", "win", F.round(F.col("excess") + 1e-9, 6).alias("excess"), "confidence")


def _head(name):
    parts = [f"{MODEL[name][0]}::DOUBLE"] + [f"(coalesce({c}, 0) - {m}::DOUBLE) / {s or 1.0}::DOUBLE * {w}::DOUBLE" for c, m, s, w in zip(MODEL["features"], MODEL["mean"], MODEL["scale"], MODEL[name][1:], strict=True)]
    return f"({' + '.join(parts)})"


def _chance(name):
    return f"round(1 / (1 + exp(-greatest(-35, least(35, {_head(name)})))), 6) AS {name}"


HEADS_SQL = with_(*X.BASE) + f"SELECT code, date, {_chance('early_stop')}, {_chance('win')}, round(round({_head('excess')}, 8) + 1e-9, 6) AS excess, 'MEDIUM' AS confidence FROM pan"


def adaptive_priority(spark, sf_dir):
    """Priorities with the setup score as adaptive score where there is a setup, as under an approved registry."""
    rows = T.priority_score(spark, sf_dir).join(T.setup_and_risk(spark, sf_dir), "code")
    rows = rows.select("code", "priority", F.col("setup_score").alias("adaptive_score"), (F.col("setup") != "NONE").alias("approved"))
    return rows.select("code", F.expr(G.blended_priority()).alias("priority"), "approved")


PRIORITY_SQL = f"SELECT code, {G.blended_priority()} AS priority, approved FROM (SELECT code, priority, setup_score AS adaptive_score, setup <> 'NONE' AS approved FROM ({T.ORACLES['priority_score']}) JOIN ({T.ORACLES['setup_and_risk']}) USING (code))"

QUERIES = {f.__name__: f for f in (model_choices, calibration_due, promotion_readiness, predicted_heads, adaptive_priority)}
ORACLES = dict(zip(QUERIES, (CHOICES_SQL, DUE_SQL, READINESS_SQL, HEADS_SQL, PRIORITY_SQL), strict=True))
