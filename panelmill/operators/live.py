"""Live performance of models: observations carried from run to run, and the verdict on each current model's path.

A run compares what is published now with the record of the run before (its baseline, count, latest date and latest
observation). The record of a rejected run is the next one's comparison too, so a reset is reported once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import canonical as N
from panelmill.operators.factors import reasons

#: Observations before returns over 20 and over 60 of them count; limits of falls and of those returns.
FEW, MANY = 20, 60
RELATIVE_FALL, OWN_FALL, RETURN_20, RETURN_60 = -0.10, -0.15, -0.05, -0.08
#: Days after a model's generation without a new calibration, and after an expected session without a record of it.
COOL_DOWN, GRACE = 7, 1
#: Evidence of a portfolio's state that is final, and that which excuses a replaced observation.
FINAL = ["BROKER_RECONCILED", "NO_EXECUTION_REQUIRED"]
KNOWN = [*FINAL, "MODEL_ESTIMATE_PENDING", "INITIAL_STATE", "LEGACY_UNVERIFIED"]
NAVS = ["strategy_nav", "benchmark_nav", "relative_nav"]
FIELDS = ["date", *NAVS, "model", "evidence"]
RECORD = ["baseline_id", "latest_id", "latest_date", "observations"]


def merged_history(before: DataFrame, batch: DataFrame, keys: list[str], day: str, keep: int = 365) -> DataFrame:
    """Rows of before and batch by key and day, those of the batch in place of older ones, the last `keep` days of each key.

    Both tables have the same columns. Of repeated rows of one table for one day the greatest counts. A null key is a key;
    rows without a day are left out. Days are merged by (key, day) and Spark limits the ranks before it shuffles by key, so
    a key with a third of all rows sends at most `keep` rows from each task.
    """
    values = [c for c in before.columns if c not in (*keys, day)]
    both = before.select("*", F.lit(0).alias("__run")).unionByName(batch.select("*", F.lit(1).alias("__run"))).where(F.col(day).isNotNull())
    merged = both.groupBy(*keys, day).agg(F.max(F.struct("__run", *values)).alias("__row"))
    ranked = merged.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(day).desc())))
    return ranked.where(F.col("__rank") <= keep).select(*[F.col(f"__row.{c}").alias(c) if c in values else F.col(c) for c in before.columns])


def observations(history: DataFrame) -> DataFrame:
    """code, FIELDS and id, the digest of an observation's canonical JSON. Other columns are dropped."""
    rows = history.select("code", F.struct(*FIELDS).alias("o"))
    return rows.select("code", "o.*", N.identity(F.col("o"), rows.schema["o"].dataType, "compact").alias("id"))


def records(observed: DataFrame, baselines: DataFrame) -> DataFrame:
    """What a run leaves for the next, one row a code: RECORD, and how many days repeat, rows lack a day or a positive value.

    baselines: code and whatever makes up a baseline. A code without a baseline has a null id, which nothing compares with.
    Rows meet by (code, date) first, so a code with many of them is one row a day afterwards.
    """
    kept = [c for c in baselines.columns if c != "code"]
    base = baselines.select("code", F.struct(*kept).alias("b"))
    base = base.groupBy("code").agg(F.min(N.identity(F.col("b"), base.schema["b"].dataType, "compact")).alias("baseline_id"))
    fine = F.lit(True)
    for nav in NAVS:
        fine = fine & F.coalesce((F.col(nav) > 0) & ~F.isnan(nav), F.lit(False))
    days = observed.groupBy("code", "date").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), F.count_if(~fine).alias("bad"))
    found = days.groupBy("code").agg(
        F.sum("n").alias("observations"),
        F.max("date").alias("latest_date"),
        F.max_by("id", F.struct("date")).alias("latest_id"),
        F.count_if(F.col("date").isNull() | (F.col("n") > 1)).alias("bad_days"),
        F.sum("bad").alias("bad_values"),
    )
    return found.join(base, "code", "left")


#: What is wrong with the present observations of a code, or with them beside the run before (p_).
BROKEN = [
    ("LIVE_PERFORMANCE_DATES_INVALID", "bad_days > 0"),
    ("LIVE_PERFORMANCE_NAV_INVALID", "bad_values > 0"),
    ("LIVE_PERFORMANCE_BASELINE_RESET", "p_baseline_id <> baseline_id"),
    ("LIVE_PERFORMANCE_OBSERVATION_COUNT_ROLLBACK", "observations < p_observations"),
    ("LIVE_PERFORMANCE_HISTORY_DATE_ROLLBACK", "latest_date < p_latest_date"),
    ("LIVE_PERFORMANCE_HISTORY_CONTINUITY_BROKEN", "latest_date > p_latest_date AND NOT coalesce(same OR excused, false)"),
]


def continuity(observed: DataFrame, baselines: DataFrame, prior: DataFrame | None) -> DataFrame:
    """RECORD of every code observed now, with findings (an array, empty if all is well).

    prior: code and RECORD of the run before; None or without a code: nothing to compare with. An observation holds its
    day, so that of the run before can only be met on its day: one join by (code, date) finds it or its replacement.
    """
    now = records(observed, baselines)
    prior = now.select("code", *RECORD).where(F.lit(False)) if prior is None else prior
    at = prior.select("code", F.col("latest_date").alias("date"), F.col("latest_id").alias("p_id"))
    met = observed.select("code", "date", "id", "evidence").join(at, ["code", "date"]).groupBy("code")
    met = met.agg(F.bool_or(F.col("id") == F.col("p_id")).alias("same"), F.bool_or(F.coalesce(F.col("evidence").isin(KNOWN), F.lit(False))).alias("excused"))
    both = now.join(prior.select("code", *[F.col(c).alias(f"p_{c}") for c in RECORD]), "code", "left").join(met, "code", "left")
    return both.select("code", *RECORD, reasons(BROKEN).alias("findings"))


#: The first that holds is a code's status; with it, whether the model keeps its authority. `hard` and `soft` are reasons.
STATUSES = [
    ("LIVE_PERFORMANCE_EVIDENCE_REJECTED", "size(findings) > 0", "false"),
    ("LIVE_PERFORMANCE_SESSION_MISSED", f"observations IS NULL AND datediff(today, expected) > {GRACE}", "false"),
    ("NO_LIVE_PERFORMANCE_EVIDENCE", "observations IS NULL", "true"),
    ("LIVE_PERFORMANCE_MODEL_SESSION_MISMATCH", "current IS NULL AND latest_date >= expected", "false"),
    ("WARMUP_CURRENT_MODEL_NOT_OBSERVED", "current IS NULL", "true"),
    ("LIVE_PERFORMANCE_BROKER_RECONCILIATION_PENDING", "latest_date >= expected AND evidence = 'MODEL_ESTIMATE_PENDING'", "today <= expected"),
    ("LIVE_PERFORMANCE_STATE_EVIDENCE_NOT_FINAL", f"latest_date >= expected AND NOT coalesce(evidence IN ('{"', '".join(FINAL)}'), false)", "today <= expected"),
    ("LIVE_RISK_LIMIT_BREACH", "size(hard) > 0", "false"),
    ("WATCH_RECALIBRATION_COOLDOWN", "size(soft) > 0 AND cooling", "true"),
    ("LIVE_MODEL_RECALIBRATION_REQUIRED", "size(soft) > 0", "true"),
    ("WARMUP", f"current < {FEW}", "true"),
    ("ACTIVE", "true", "true"),
]
HARD = [("LIVE_RELATIVE_DRAWDOWN_BREACH", f"relative_fall <= {RELATIVE_FALL}"), ("LIVE_STRATEGY_DRAWDOWN_BREACH", f"own_fall <= {OWN_FALL}")]
SOFT = [(f"LIVE_ROLLING_{n}_RELATIVE_UNDERPERFORMANCE", f"return_{n} <= {least}") for n, least in ((FEW, RETURN_20), (MANY, RETURN_60))]


def current_paths(observed: DataFrame, models: DataFrame) -> DataFrame:
    """The unbroken run of the current model at each code's end: its length, falls from the peak, returns over 20 and 60 records.

    One row a code that has such a run. All windows share one shuffle by code; a code has a row a day, bounded by the
    calendar. Rows without a day are no part of it.
    """
    rows = observed.where("date IS NOT NULL").join(models.select("code", F.col("model").alias("wanted")), "code")
    every = Window.partitionBy("code")
    other = F.when(~F.col("model").eqNullSafe(F.col("wanted")), F.col("date"))
    rows = rows.withColumn("before", F.max(other).over(every)).where("before IS NULL OR date > before")
    fall = lambda c: F.col(c) / F.max(c).over(every.orderBy("date")) - 1
    rows = rows.withColumns({"own": fall("strategy_nav"), "relative": fall("relative_nav"), "back": F.row_number().over(every.orderBy(F.col("date").desc()))})
    nav = lambda k: F.max(F.when(F.col("back") == k, F.col("relative_nav")))
    return rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("current"),
        F.min("own").alias("own_fall"),
        F.min("relative").alias("relative_fall"),
        *[F.when(nav(n + 1) > 0, nav(1) / nav(n + 1) - 1).alias(f"return_{n}") for n in (FEW, MANY)],
        F.max_by("evidence", "date").alias("evidence"),
    )


def audit(history: DataFrame, baselines: DataFrame, models: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """One row a model: RECORD for the next run, findings, the current model's path, hard and soft reasons, status, allowed, recalibrate.

    history: code and FIELDS; models: code, model, generated, today, expected (the session of the current model's next
    execution, or null). A model's code that is not observed keeps the RECORD of the run before; histories of no model
    are left out. A null generated counts as today. Limits are compared before values are rounded to 8 digits.
    """
    observed = observations(history)
    rows = models.join(continuity(observed, baselines, prior), "code", "left").join(current_paths(observed, models), "code", "left")
    rows = rows.withColumns({"findings": F.coalesce("findings", F.array().cast("array<string>")), "hard": reasons(HARD), "soft": reasons(SOFT), "cooling": F.coalesce(F.datediff("today", "generated"), F.lit(0)) < COOL_DOWN})
    case = lambda k: F.expr("CASE " + " ".join(f"WHEN {s[1]} THEN {s[k] if k else repr(s[0])}" for s in STATUSES) + " END")
    rows = rows.withColumns({"status": case(0), "allowed": case(2)})
    judged = F.col("status").isin([s[0] for s in STATUSES[7:]])
    rows = rows.withColumn("recalibrate", judged & (F.size(F.concat("hard", "soft")) > 0) & ~F.col("cooling"))
    if prior is not None:
        old = prior.select("code", *[F.col(c).alias(f"p_{c}") for c in RECORD])
        seen = F.col("observations").isNotNull()
        rows = rows.join(old, "code", "left").withColumns({c: F.when(seen, F.col(c)).otherwise(F.col(f"p_{c}")) for c in RECORD})
    rounded = [F.round(c, 8).alias(c) for c in ("own_fall", "relative_fall", "return_20", "return_60")]
    return rows.select("code", *RECORD, "findings", F.coalesce("current", F.lit(0)).alias("current"), *rounded, "hard", "soft", "status", "allowed", "recalibrate")
