"""Three-period scores to a status: resonance, conflicts between periods, buckets, phases of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of bonus and penalty.
RESONANCE, DIVERGENCE = 0.6, -1.8
#: Name, least monthly, weekly and daily score, least of the three; factor and cap of the bonus. The first that holds counts.
STRENGTHS = [("strong", 2.5, 4.0, 1.5, 0.0, 1.15, 2.4), ("medium", 0.0, 0.0, 0.0, 1.0, 1.0, 1.5), ("weak", 0.0, 0.0, 0.0, 0.0, 0.65, 0.6)]
#: Tag, condition, what drags with its ramp, what pushes with its ramp, their shares, and the share of the penalty.
CONFLICTS = [
    ("WEEK_UP_DAY_DOWN", "w > 2.5 AND d < 0", ("w", 2.5, 5.0), ("-d", 0.0, 3.0), 0.55, 0.45, 1.0),
    ("WEEK_DOWN_DAY_UP", "w < -2.5 AND d > 0", ("-w", 2.5, 5.0), ("d", 0.0, 3.0), 0.55, 0.45, 0.8),
    ("MONTH_DOWN_WEEK_UP", "m < -0.5 AND w > 2.0", ("-m", 0.5, 3.0), ("w", 2.0, 5.0), 0.45, 0.55, 0.45),
    ("MONTH_UP_WEEK_FLAT", "m > 1.5 AND w < 1.5", ("m", 1.5, 4.0), ("1.5 - w", 0.0, 3.0), 0.45, 0.55, 0.35),
]
#: Conflicts whose penalty is halved where the daily reason already holds the loss (column discounted).
HALVED = ("WEEK_UP_DAY_DOWN", "WEEK_DOWN_DAY_UP")
#: Status and the least total; below all of them, the mirrored ones.
BUCKETS = [("EXTREME_BULL", 14.0), ("BULL", 7.0), ("WEAK_BULL", 2.5)]


def ramp(value: Column, start: float, full: float) -> Column:
    """0 up to start, 1 from full on, straight between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - start) / (full - start)))


def resonance() -> tuple[Column, Column]:
    """Strength of agreement of m, w and d (empty if one is not positive) and its bonus."""
    least = F.least("m", "w", "d")
    name, bonus = F.lit(""), F.lit(0.0)
    for strength, month, week, day, lowest, factor, cap in reversed(STRENGTHS):
        holds = (least > 0) & (F.col("m") >= month) & (F.col("w") >= week) & (F.col("d") >= day) & (least >= lowest)
        name, bonus = F.when(holds, strength).otherwise(name), F.when(holds, F.least(F.lit(cap), least * RESONANCE * factor)).otherwise(bonus)
    return name, bonus


def conflicts() -> tuple[Column, Column]:
    """Tags of the conflicts between the periods and the sum of their penalties (not positive)."""
    tags, total = [], F.lit(0.0)
    for tag, condition, (a, a0, a1), (b, b0, b1), share, other, weight in CONFLICTS:
        severity = F.greatest(F.lit(0.2), F.least(F.lit(1.0), ramp(F.expr(a), a0, a1) * share + ramp(F.expr(b), b0, b1) * other))
        part = severity * (DIVERGENCE * weight)
        if tag in HALVED:
            part = F.when(F.col("discounted"), part * 0.5).otherwise(part)
        tags.append(F.when(F.expr(condition), tag))
        total = total + F.when(F.expr(condition), part).otherwise(0.0)
    return F.array_compact(F.array(*tags)), total


def bucket(total: Column) -> Column:
    """The seven statuses of a total."""
    out = F.lit("NEUTRAL")
    for name, edge in reversed(BUCKETS):
        out = F.when(total >= edge, name).when(total <= -edge, name.replace("BULL", "BEAR")).otherwise(out)
    return out


def score_status(df: DataFrame) -> DataFrame:
    """Add strength, bonus, penalty, tags, total (one digit) and status; df: m, w, d (scores by month, week, day) and discounted."""
    strength, bonus = resonance()
    tags, penalty = conflicts()
    df = df.withColumns({"strength": strength, "bonus": F.round(bonus, 6), "penalty": F.round(penalty, 6), "tags": F.array_join(tags, ",")})
    df = df.withColumn("total", F.round(F.col("m") + F.col("w") + F.col("d") + F.col("bonus") + F.col("penalty") + 1e-7, 1))
    return df.withColumn("status", bucket(F.col("total")))


def change_signal(df: DataFrame) -> DataFrame:
    """One row a key from its last two records: has the status changed, turned up or down, is the score accelerating.

    df: key, day, status (level, 3 and 4 are up, 0 and 1 down), score. Keys with one record give none.
    """
    last = df.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("day", "status", "score")), asc=False), 1, 2).alias("h")).where(F.size("h") == 2)
    now, before = F.col("h")[0], F.col("h")[1]
    up, down = (lambda x: x["status"] >= 3), (lambda x: x["status"] <= 1)
    return last.select("key", (now["status"] != before["status"]).alias("status_changed"), (up(now) & ~up(before)).alias("turned_up"), (down(now) & ~down(before)).alias("turned_down"), (F.abs(now["score"] - before["score"]) > 2.0).alias("accelerating"))
