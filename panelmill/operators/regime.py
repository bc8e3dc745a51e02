"""Rotation by market regime: weights, eligibility, liquidity floor, one name a group, broad-market fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.windows import percentile_rank

#: Weights of the percentile ranks in either regime.
DEFENSIVE_WEIGHTS = {"relative_strength": 0.42, "momentum_20": 0.12, "weekly_trend": 0.08, "trend_efficiency_20": 0.18, "volume_confirmation": 0.12, "priority": 0.08}
RECOVERY_WEIGHTS = {"relative_strength": 0.22, "momentum_20": 0.30, "weekly_trend": 0.18, "trend_efficiency_20": 0.14, "volume_confirmation": 0.10, "priority": 0.06}
#: Floors of the weekly trend, and the market score from which a market recovers.
TREND_FLOOR, EARLY_FLOOR, RECOVERY_FLOOR, DEFENSE_FLOOR, RECOVERY_SCORE = -0.10, -0.15, 0.05, 0.0, 0.0
DEFENSE_STATES = ("DEFENSIVE", "HARD_DEFENSIVE", "RISK_OFF")
FALLBACK_CODE, FALLBACK_GROUP, FALLBACK_SCORE, LEAST_RISK_NAMES = "BROAD", "broad_market", 0.5, 2


def recovering() -> Column:
    """Whether a date's market recovers: a full or early pulse, or a score that is not negative."""
    return F.col("market_state").startswith("PULSE_FULL") | F.col("market_state").startswith("PULSE_EARLY") | (F.col("market_score") >= RECOVERY_SCORE)


def regime_scores(df: DataFrame) -> DataFrame:
    """Add recovery and rotation_score; df: date, code, the features of the weights, market_state, market_score (alike on a date)."""
    df = df.fillna(0.0, list(DEFENSIVE_WEIGHTS)).withColumn("recovery", recovering())
    ranks = {name: percentile_rank(name, "date") for name in DEFENSIVE_WEIGHTS}
    mix = lambda weights: sum((F.lit(w) * ranks[name] for name, w in weights.items()), F.lit(0.0))
    return df.withColumn("rotation_score", F.round(F.when(F.col("recovery"), mix(RECOVERY_WEIGHTS)).otherwise(mix(DEFENSIVE_WEIGHTS)), 9))


def trend_floor() -> Column:
    """The least weekly trend that is eligible on a date."""
    hard = F.col("market_state").isin(*DEFENSE_STATES) | F.col("market_state").startswith("PULSE_HARD")
    base = F.when(hard, F.lit(DEFENSE_FLOOR)).otherwise(TREND_FLOOR)
    early = F.col("market_state").startswith("PULSE_EARLY")
    soft = F.when(early, F.least(base, F.lit(EARLY_FLOOR))).when(F.col("market_state") == "PULSE_HARD", F.greatest(base, F.lit(DEFENSE_FLOOR))).otherwise(F.greatest(base, F.lit(RECOVERY_FLOOR)))
    return F.when(F.col("recovery"), soft).otherwise(base)


def eligible(scored: DataFrame, defensive: list[str], least_amount: float = 0.0) -> DataFrame:
    """Rows that may be held: trend floor; in a recovery no falling name and no defensive group (outside pulses only if it does not rise); liquidity floor."""
    pure = F.col("industry_group").isin(*defensive)
    keep = ~pure | (~F.col("market_state").startswith("PULSE") & (F.col("momentum_20") > 0))
    ok = (F.col("weekly_trend") >= trend_floor()) & (~F.col("recovery") | (keep & (F.col("momentum_20") >= 0)))
    return scored.where(ok & (F.col("amount") >= least_amount))


def select_targets(scored: DataFrame, defensive: list[str], n: int = 3, least_amount: float = 0.0) -> DataFrame:
    """date, slot, code, industry_group, rotation_score: the best name of each group, the best n of them, and the fallback.

    In a recovery with fewer than two names outside defensive groups, the broad market (if it is liquid:
    column broad_amount) stands for all, joins at the end, or takes the place of the weakest defensive name; not where a name of its group is held.
    """
    order = [F.desc("rotation_score"), "code"]
    best = eligible(scored, defensive, least_amount).withColumn("g", F.row_number().over(Window.partitionBy("date", "industry_group").orderBy(*order))).where("g = 1")
    picks = best.withColumn("slot", F.row_number().over(Window.partitionBy("date").orderBy(*order))).where(F.col("slot") <= n)
    pure = F.col("industry_group").isin(*defensive)
    picks = picks.select("date", "slot", "code", "industry_group", "rotation_score", pure.alias("pure"))
    dates = scored.groupBy("date").agg(F.bool_or("recovery").alias("recovery"), F.max("broad_amount").alias("broad_amount"))
    held = picks.groupBy("date").agg(F.count(F.lit(1)).alias("names"), F.count_if(~F.col("pure")).alias("risk"), F.max(F.when(F.col("pure"), F.col("slot"))).alias("weakest"), F.bool_or(F.col("industry_group") == FALLBACK_GROUP).alias("broad"))
    plan = dates.join(held, "date", "left").fillna(0, ["names", "risk"])
    plan = plan.where(F.col("recovery") & (F.col("risk") < LEAST_RISK_NAMES) & (F.col("broad_amount") >= least_amount) & ~F.coalesce("broad", F.lit(False)))
    place = F.when(F.col("risk") == 0, 1).when(F.col("names") < n, F.col("names") + 1).otherwise(F.coalesce("weakest", "names")).cast("int")
    plan = plan.select("date", place.alias("place"), (F.col("risk") == 0).alias("alone"))
    kept = picks.join(plan, "date", "left").where(F.col("place").isNull() | (~F.col("alone") & (F.col("slot") != F.col("place"))))
    more = plan.select("date", F.col("place").alias("slot"), F.lit(FALLBACK_CODE).alias("code"), F.lit(FALLBACK_GROUP).alias("industry_group"), F.lit(FALLBACK_SCORE).alias("rotation_score"))
    return kept.select("date", "slot", "code", "industry_group", "rotation_score").unionByName(more)
