"""Event tables and ledgers. Every function works on batch and, where it has a time window, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values that a weighted quantile looks at before single values.
CELLS = 1024


def tumbling_bars(events: DataFrame, every: str = "1 day") -> DataFrame:
    """Open, high, low, close, volume of values by event type and time window."""
    order = F.struct("ts", "event_id")
    bars = events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("events"))
    return bars.select(F.col("w.start").alias("start"), "event_type", "open", "high", "low", "close", "events")


def sliding_breadth(events: DataFrame, span: str = "7 days", slide: str = "1 day", level: float = 50.0) -> DataFrame:
    """Share of values above a level less share at or below it, in sliding windows."""
    up = F.count_if(F.col("value") > level)
    n = F.count(F.lit(1))
    out = events.groupBy(F.window("ts", span, slide).alias("w")).agg(n.alias("events"), up.alias("above"))
    return out.select(F.col("w.start").alias("start"), "events", "above", F.round((2 * F.col("above") - F.col("events")) / F.col("events"), 6).alias("breadth"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: runs of events with no pause of gap or longer."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def weighted_quantile(df: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """The least value whose cumulative weight reaches q of the total; no interpolation.

    Weights are summed over CELLS equal ranges of a group's values first; only the range in which the quantile falls
    is ordered value by value.
    """
    ends = df.groupBy(group).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    cell = F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0)) * (CELLS - 1))
    placed = df.select(group, value, weight).join(ends, group).withColumn("__cell", cell)
    upto = Window.partitionBy(group).orderBy("__cell")
    cells = placed.groupBy(group, "__cell").agg(F.sum(weight).alias("__w"))
    cells = cells.withColumns({"__upto": F.sum("__w").over(upto), "__all": F.sum("__w").over(Window.partitionBy(group))})
    cells = cells.where((F.col("__upto") >= q * F.col("__all")) & (F.col("__upto") - F.col("__w") < q * F.col("__all")))
    near = placed.select(group, value, weight, "__cell").join(cells, [group, "__cell"]).groupBy(group, value).agg(F.sum(weight).alias("__v"), F.first("__upto").alias("__upto"), F.first("__w").alias("__w"), F.first("__all").alias("__all"))
    reached = F.col("__upto") - F.col("__w") + F.sum("__v").over(Window.partitionBy(group).orderBy(value)) >= q * F.col("__all")
    return near.withColumn("__ok", reached).where("__ok").groupBy(group).agg(F.min(value).alias("quantile"))


def degraded_runs(samples: DataFrame, key: str, order: list, n: int = 3, least_gross: float = 5000.0, ratio: float = 1.25, excess_bps: float = 2.0) -> DataFrame:
    """Add degraded: the last n samples all cost more than ratio times the model and their gross and excess are large enough."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    all_over = F.bool_and(F.col("actual") > ratio * F.col("expected")).over(w)
    gross, excess = F.sum("gross").over(w), F.sum(F.col("actual") - F.col("expected")).over(w)
    return samples.withColumn("degraded", (F.count(F.lit(1)).over(w) == n) & all_over & (gross >= least_gross) & (excess / gross * 10000 >= excess_bps))


def ledger(events: DataFrame) -> DataFrame:
    """State of each plan after all its events: the last event decides, repeated ids count once.

    events: event_id, plan_id, ts, event_type. A plan is superseded if the same key has a later plan of
    the same day; it is overdue if it stays open for 7 days before the newest event.
    """
    once = events.groupBy("event_id").agg(*[F.min_by(c, "ts").alias(c) for c in ("plan_id", "day", "user_id", "event_type")], F.min("ts").alias("ts"))
    order = F.struct("ts", "event_id")
    plans = once.groupBy("plan_id", "user_id", "day").agg(F.count(F.lit(1)).alias("events"), F.max_by("event_type", order).alias("last_type"), F.max("ts").alias("last_ts"))
    newest = once.agg(F.max("ts")).scalar()
    later = F.max("plan_id").over(Window.partitionBy("user_id", "day"))
    closed = F.col("last_type") == "purchase"
    state = F.when(F.col("plan_id") < later, "SUPERSEDED").when(closed, "OBSERVED").when(F.col("last_ts") < newest - F.expr("INTERVAL 7 DAYS"), "OVERDUE").otherwise("PENDING")
    return plans.withColumn("state", state).select("plan_id", "user_id", "events", "last_type", "state")


def hysteresis(statuses: DataFrame) -> DataFrame:
    """Published status by key and day: a change needs two raw readings in a row, or a jump of two levels.

    The published status depends on the one before, so it is a fold over one key's days.
    """
    h = statuses.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("day", "level"))).alias("h"))
    start = F.struct(F.element_at("h", 1)["level"].alias("pub"), F.element_at("h", 1)["level"].alias("raw"), F.lit(0).cast("bigint").alias("changes"))

    def step(acc, x):
        go = (x["level"] != acc["pub"]) & ((x["level"] == acc["raw"]) | (F.abs(x["level"] - acc["pub"]) >= 2))
        return F.struct(F.when(go, x["level"]).otherwise(acc["pub"]).alias("pub"), x["level"].alias("raw"), (acc["changes"] + go.cast("bigint")).alias("changes"))

    end = F.aggregate(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), start, step)
    return h.select("key", end["pub"].alias("status"), end["changes"].alias("changes"))


def violations(df: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """One row for each rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(condition), F.lit(False)), name) for name, condition in rules.items()]))
    return df.select(*key, F.explode(broken).alias("violation"))
