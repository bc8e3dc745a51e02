"""Rotation ranks: relative strength, weighted rank scores, best of each group, and the rank buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.windows import by_code, clip, percentile_rank

#: Features and weights of the score, before they are normalised.
SLICE_WEIGHTS = [("momentum_20", 0.30), ("trend_efficiency_20", 0.14), ("volume_confirmation", 0.10)]
HORIZON_WEIGHTS = {20: 0.5, 60: 0.3, 120: 0.2}


def rotation_score(df: DataFrame, weights: list[tuple[str, float]] = SLICE_WEIGHTS) -> DataFrame:
    """Add rotation_score: the normalised weighted sum of percentile ranks within a date."""
    total = sum(w for _, w in weights)
    score = None
    for name, weight in weights:
        term = F.lit(weight / total) * percentile_rank(name, "date")
        score = term if score is None else score + term
    return df.withColumn("rotation_score", F.round(score, 9))


def top_by_group(scored: DataFrame, n: int) -> DataFrame:
    """The best of each group, then the best n of a date; ties by code."""
    order = [F.desc("rotation_score"), "code"]
    best = scored.withColumn("__g", F.row_number().over(Window.partitionBy("date", "industry_group").orderBy(*order))).where("__g = 1").drop("__g")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(*order))).where(F.col("rank") <= n)


def buffered(ranked: DataFrame, n: int, buffer: int) -> DataFrame:
    """n names a date out of the first n + buffer: last date's first n stay before others, each in order of rank."""
    dates = ranked.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))  # one row a date
    before = ranked.where(F.col("rank") <= n).join(dates, "date").select(F.col("next").alias("date"), "code", F.lit(True).alias("incumbent"))
    rows = ranked.where(F.col("rank") <= n + buffer).join(before, ["date", "code"], "left").withColumn("incumbent", F.coalesce("incumbent", F.lit(False)))
    order = Window.partitionBy("date").orderBy(F.desc("incumbent"), "rank")
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")


def strength_inputs(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """code, date, beta and raw20, raw60, raw120: risk-adjusted excess returns at every bar, null without enough history.

    The tracking error of residuals under today's beta has the closed form
    sqrt(var_a + beta^2 var_b - 2 beta cov), so no residual series is built for each row. Moments of the last n returns are
    differences of running sums, so a bar costs the same for every n. m and t: number of the bar, and of all.
    """
    rows = bars.select("code", "date", "close").join(bench, "date")
    lag = lambda c, n: F.lag(c, n).over(by_code())
    rows = rows.withColumns({"ra": F.col("close") / lag("close", 1) - 1, "rb": F.col("bench") / lag("bench", 1) - 1, "m": F.row_number().over(by_code()), "t": F.count(F.lit(1)).over(Window.partitionBy("code"))})
    sums = {"a": F.col("ra"), "b": F.col("rb"), "aa": F.col("ra") * F.col("ra"), "bb": F.col("rb") * F.col("rb"), "ab": F.col("ra") * F.col("rb")}
    running = by_code().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s_{k}": F.coalesce(F.sum(v).over(running), F.lit(0.0)) for k, v in sums.items()})
    frames = sorted({max(60, n) for n in HORIZON_WEIGHTS})
    rows = rows.withColumns({f"{k}_{n}": F.col(f"s_{k}") - F.coalesce(lag(f"s_{k}", n), F.lit(0.0)) for k in sums for n in frames})
    # The first bar has no return.
    count = lambda n: F.least(F.col("m") - 1, F.lit(n))
    spread = lambda x, y, n: F.col(f"{x}{y}_{n}") - F.col(f"{x}_{n}") * F.col(f"{y}_{n}") / count(n)
    ample = F.col("m") >= 21
    n = max(HORIZON_WEIGHTS)
    free = F.when(ample, spread("b", "b", n) / count(n))
    rows = rows.withColumn("beta", F.when(ample & (free > 1e-10), clip(spread("a", "b", n) / (count(n) - 1) / free, -0.5, 2.5)).otherwise(1.0))
    for n in HORIZON_WEIGHTS:
        w, b = max(60, n), F.col("beta")
        alpha = F.ln(F.col("close") / lag("close", n)) - b * F.ln(F.col("bench") / lag("bench", n))
        residual = (spread("a", "a", w) + b * b * spread("b", "b", w) - 2 * b * spread("a", "b", w)) / (count(w) - 1)
        error = F.sqrt(F.greatest(residual, F.lit(0.0))) * F.sqrt(F.lit(float(n)))
        rows = rows.withColumn(f"raw{n}", F.when(F.col("m") > n + 1, F.round(alpha / F.greatest(error, F.lit(0.01)), 9)))
    return rows.select("code", "date", "m", "t", "beta", *[f"raw{n}" for n in HORIZON_WEIGHTS])


def strength_score(rows: DataFrame, *by: str) -> DataFrame:
    """Add strength (0 to 100): winsorised percentile ranks within by of the raw strengths, weighted over the horizons that a row has; and has_120."""
    whole = Window.partitionBy(*by)
    score, weight = F.lit(0.0), F.lit(0.0)
    for n, part in HORIZON_WEIGHTS.items():
        low, high = F.percentile(f"raw{n}", 0.05).over(whole), F.percentile(f"raw{n}", 0.95).over(whole)
        rows = rows.withColumn("__has", F.col(f"raw{n}").isNotNull()).withColumn("__cut", F.greatest(low, F.least(high, f"raw{n}")))
        rows = rows.withColumn(f"p{n}", F.when(F.col("__has"), percentile_rank("__cut", *by, "__has") * 100)).drop("__cut", "__has")
        score, weight = score + F.coalesce(F.col(f"p{n}"), F.lit(0.0)) * part, weight + F.when(F.col(f"p{n}").isNotNull(), part).otherwise(0.0)
    return rows.withColumns({"has_120": F.col("p120").isNotNull(), "strength": F.round(clip(F.coalesce(F.try_divide(score, weight), F.lit(0.0)), 0, 100), 3)}).drop(*[f"p{n}" for n in HORIZON_WEIGHTS])


def relative_strength(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """code, beta, has_120, score at the last bar of each instrument, ranked over all of them."""
    last = strength_score(strength_inputs(bars, bench).where("m = t"))  # one row an instrument
    return last.select("code", F.round("beta", 4).alias("beta"), "has_120", F.col("strength").alias("score"))
