"""Holdings that a rank buffer keeps from date to date, the choice of a buffer, and the gates of an accepted rotation.

What is held at a date depends on what was held before, so holdings are an ordered fold over the ranked lists of the dates, with
the held names as state. Buffers and sleeves are lanes that fold side by side; a lane reads at most n + buffer names a date, so it is bounded by the calendar.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most drawdown of a buffer that may be chosen, years kept for the audit, periods of a rolling window.
MOST_DRAWDOWN, AUDIT_YEARS, ROLLING = 0.25, 3, 52
HELD = "buffer int, sleeve int, date date, slot int, code string, incumbent boolean"
#: Gates of a rotation and when each holds; names of the recent holdout begin with recent_. Null counts as not met.
GATES = [
    ("benchmark_excess_positive", "excess_return > 0"),
    ("information_ratio_above_0_25", "information_ratio > 0.25"),
    ("drawdown_not_worse_than_benchmark", "max_drawdown <= benchmark_drawdown"),
    ("absolute_max_drawdown_at_most_0_25", "max_drawdown <= 0.25"),
    ("positive_year_ratio_min_0_60", "years >= 5 AND positive_years >= 0.60"),
    ("rolling_12m_observations_min_104", "rolling >= 104"),
    ("rolling_12m_positive_excess_ratio_min_0_60", "rolling_positive >= 0.60"),
    ("rolling_12m_worst_excess_at_least_minus_0_25", "rolling_worst >= -0.25"),
    ("max_relative_drawdown_at_most_0_30", "relative_drawdown <= 0.30"),
    ("relative_underwater_periods_at_most_260", "under_water <= 260"),
    ("recent_holdout_excess_positive", "recent_excess_return > 0"),
    ("recent_holdout_information_ratio_above_0_25", "recent_information_ratio > 0.25"),
    ("recent_holdout_max_drawdown_at_most_0_25", "recent_max_drawdown <= 0.25"),
    ("recent_holdout_positive_year_ratio_min_0_50", "recent_years >= 2 AND recent_positive_years >= 0.50"),
    ("recent_holdout_rolling_12m_observations_min_26", "recent_rolling >= 26"),
    ("recent_holdout_rolling_positive_excess_ratio_min_0_60", "recent_rolling_positive >= 0.60"),
    ("recent_holdout_rolling_worst_excess_at_least_minus_0_20", "recent_rolling_worst >= -0.20"),
    ("recent_holdout_max_relative_drawdown_at_most_0_25", "recent_relative_drawdown <= 0.25"),
    ("recent_holdout_relative_underwater_periods_at_most_104", "recent_under_water <= 104"),
    ("capacity_fill_ratio_min_0_90", "capacity_fill >= 0.90"),
    ("recent_holdout_capacity_fill_ratio_min_0_90", "recent_capacity_fill >= 0.90"),
]


def next_holding(held: list[str], ranked: list[str], n: int) -> tuple[list[str], int]:
    """The names held after a date, and how many of them stay: first those held before that still rank, in their order, then the best others."""
    stays = [code for code in held if code in set(ranked)][:n]
    return [*stays, *[code for code in ranked if code not in set(stays)]][:n], len(stays)


def held(ranked: DataFrame, n: int, buffers: tuple[int, ...] = (0, 1, 2, 3), sleeves: int = 1) -> DataFrame:
    """buffer, sleeve, date, slot, code, incumbent for each buffer and date.

    ranked: date, rank (from 1, one a group and name), code. Dates are dealt to sleeves in turn; a sleeve keeps its own names. A date with no
    names empties its sleeve only if it has a row, so give a null code for such dates; they hold nothing.
    """

    def fold(lane: pa.Table) -> pa.Table:
        rows, out, names = lane.sort_by([("date", "ascending"), ("rank", "ascending")]).to_pylist(), [], []
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to]["date"] == rows[at]["date"]:
                to += 1
            names, stays = next_holding(names, [r["code"] for r in rows[at:to] if r["code"] is not None], n)
            out += [{"buffer": rows[at]["buffer"], "sleeve": rows[at]["sleeve"], "date": rows[at]["date"], "slot": k + 1, "code": c, "incumbent": k < stays} for k, c in enumerate(names)]
            at = to
        kinds = {"buffer": pa.int32(), "sleeve": pa.int32(), "date": pa.date32(), "slot": pa.int32(), "code": pa.string(), "incumbent": pa.bool_()}
        return pa.Table.from_pylist(out, pa.schema(list(kinds.items())))

    turn = ranked.select("date").distinct().withColumn("sleeve", ((F.row_number().over(Window.orderBy("date")) - 1) % sleeves).cast("int"))  # one row a date
    lanes = F.explode(F.array(*[F.lit(b) for b in buffers]))
    rows = ranked.select("date", F.col("rank").cast("int").alias("rank"), "code", lanes.alias("buffer")).where(F.col("rank") <= n + F.col("buffer")).join(turn, "date")
    return rows.groupBy("buffer", "sleeve").applyInArrow(fold, HELD)


def paths(holdings: DataFrame, returns: DataFrame, market: DataFrame) -> DataFrame:
    """buffer, date, r, rb, fresh: mean return of the held names, that of the market, and the share of names that are new.

    returns: date, code, r; market: date, rb. A held name without a return counts as 0.
    """
    rows = holdings.join(returns, ["date", "code"], "left").groupBy("buffer", "date").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("r"), F.avg((~F.col("incumbent")).cast("double")).alias("fresh"))
    return rows.join(market, "date")


def path_metrics(rows: DataFrame) -> DataFrame:
    """One row a lane (code, date, r, rb): rolling, rolling_positive, rolling_worst, relative_drawdown, under_water, years.

    rolling: windows of 52 periods; their excess is the difference of compounded returns. Under water: periods in a row below the best relative value.
    """
    w = Window.partitionBy("code").orderBy("date")
    last = w.rowsBetween(1 - ROLLING, 0)
    rows = rows.withColumns({"k": F.row_number().over(w), "log": F.ln(1 + F.col("r")), "blog": F.ln(1 + F.col("rb"))})
    rows = rows.withColumns({"e": F.when(F.col("k") >= ROLLING, F.round(F.exp(F.sum("log").over(last)) - F.exp(F.sum("blog").over(last)), 9)), "rel": F.round(F.exp(F.sum(F.col("log") - F.col("blog")).over(w)), 9)})
    rows = rows.withColumn("peak", F.greatest(F.lit(1.0), F.max("rel").over(w)))
    rows = rows.withColumn("island", F.sum((F.col("rel") >= F.col("peak")).cast("int")).over(w))
    runs = rows.groupBy("code", "island").agg(F.count_if(F.col("rel") < F.col("peak")).alias("run")).groupBy("code").agg(F.max("run").alias("under_water"))
    whole = rows.groupBy("code").agg(
        F.count("e").alias("rolling"),
        F.round(F.avg(F.when(F.col("e").isNotNull(), (F.col("e") > 0).cast("double"))), 6).alias("rolling_positive"),
        F.round(F.min("e"), 6).alias("rolling_worst"),
        F.round(F.max(1 - F.col("rel") / F.col("peak")), 6).alias("relative_drawdown"),
        F.count_distinct(F.year("date")).alias("years"),
    )
    return whole.join(runs, "code")


def choose_buffer(metrics: DataFrame) -> DataFrame:
    """Add eligible and selected to rows of buffer, information_ratio, excess_return, max_drawdown, turnover; a row a buffer.

    Eligible: excess and ratio above 0 and a bounded drawdown; if none is, all compete. The best ratio wins, then excess, less turnover, the smaller buffer.
    """
    ok = (F.col("excess_return") > 0) & (F.col("information_ratio") > 0) & (F.col("max_drawdown") <= MOST_DRAWDOWN)
    rows = metrics.withColumn("eligible", F.coalesce(ok, F.lit(False)))
    order = Window.orderBy(F.desc("eligible"), F.desc_nulls_last("information_ratio"), F.desc_nulls_last("excess_return"), F.asc_nulls_last("turnover"), "buffer")
    return rows.withColumn("selected", F.row_number().over(order) == 1)


def rotation_gates(metrics: DataFrame) -> DataFrame:
    """Add failed (names of the gates that do not hold, in their order) and approved."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in GATES]))
    return metrics.withColumn("failed", F.array_join(failed, ",")).withColumn("approved", F.size(failed) == 0)
