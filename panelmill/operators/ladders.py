"""Rule scores of the month, the week and the day, at the last bar of each instrument.

The rules are data: ordered (name, condition, points) that both Spark and the comparison SQL read; the first that holds
counts. What they read is made from one ordered history a row (bounded by the calendar), so a score costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions import folds as E

Rules = list[tuple[str, str, object]]
#: Histograms and closes of the divergence test.
SPAN = 30

#: Fixed values of the monthly rules. turn: sign of the histogram's last change; ret3, ret6: returns over 3 and 6 months.
MONTH_STEPS = [
    {
        "gap": "coalesce((ma5 - ma10) / nullif(ma10, 0) * 100, 0)",
        "dev": "coalesce((close - ma5) / nullif(ma5, 0) * 100, 0)",
        "dev20": "CASE WHEN ma20 > 0 THEN (close - ma20) / ma20 * 100 ELSE 0 END",
        "turn": "coalesce(sign(h0 - h1), 0)",
        "ret3": "CASE WHEN close3 > 0 THEN (close / close3 - 1) * 100 ELSE 0 END",
        "ret6": "CASE WHEN close6 > 0 THEN (close / close6 - 1) * 100 ELSE 0 END",
    },
    {
        "flat": "abs(gap) < 1.5 AND abs(dev) < 2.5",
        "above": "ma20 IS NULL OR close > ma20",
        "below": "coalesce(close < ma20, false)",
        "bull": "(ma20 IS NULL OR close > ma20) AND ma5 > ma10 AND (ma20 IS NULL OR ma10 >= ma20 * 0.98)",
        "bear": "coalesce(close < ma20, false) AND ma5 < ma10 AND ma10 <= ma20 * 1.02",
        "strength": "least(5.0, 3.0 + abs(gap) * 0.15 + abs(h0) * 0.3)",
    },
]
MONTH: Rules = [
    ("THIN_UP", "(ma10 IS NULL OR h0 IS NULL) AND slope5 > 3", 1.5),
    ("THIN_DOWN", "(ma10 IS NULL OR h0 IS NULL) AND slope5 < -3", -1.5),
    ("THIN", "ma10 IS NULL OR h0 IS NULL", 0.0),
    ("ADVANCE", "bull AND h0 > 0 AND close > ma5 AND slope20 > 0.4 AND turn >= 0", "3.8 + least(0.8, greatest(0.0, gap) * 0.12) + least(0.4, greatest(0.0, ret3) / 20)"),
    ("ADVANCE_PAUSE", "bull AND h0 > 0 AND close < ma5 AND close > ma20", "CASE WHEN turn >= 0 THEN 2.2 ELSE 1.7 END"),
    ("BULL", "bull AND h0 > 0", "CASE WHEN turn >= 0 THEN 2.6 ELSE 2.0 END"),
    ("DECLINE", "bear AND h0 < 0 AND close < ma5 AND slope20 < -0.4 AND turn <= 0", "-3.8 - least(0.8, abs(gap) * 0.12) - least(0.4, abs(least(ret3, 0.0)) / 20)"),
    ("BEAR_REBOUND", "bear AND h0 < 0 AND close > ma5", -1.8),
    ("BEAR", "bear AND h0 < 0", "CASE WHEN turn <= 0 THEN -2.8 ELSE -2.2 END"),
    ("REPAIR", "below AND turn > 0 AND ret3 > 0", "CASE WHEN close > ma10 THEN 1.0 ELSE 0.4 END"),
    ("AGEING", "above AND turn < 0 AND ret3 < 0", "CASE WHEN close > ma10 THEN 1.2 ELSE 0.2 END"),
    ("UP_EXTREME", "ma5 > ma10 AND close > ma5 AND h0 > 0 AND gap > 4.0 AND abs(h0) > 0.8 AND dev > 2.0", "strength"),
    ("UP_STRONG", "ma5 > ma10 AND close > ma5 AND h0 > 0 AND turn > 0", "strength * 0.85"),
    ("UP", "ma5 > ma10 AND close > ma5 AND h0 > 0", "strength * 0.7"),
    ("PULLBACK", "ma5 > ma10 AND close < ma5 AND h0 > 0 AND close > ma10", "CASE WHEN turn >= 0 THEN 2.0 ELSE 1.5 END"),
    ("PULLBACK_DEEP", "ma5 > ma10 AND close < ma5 AND h0 > 0", 0.5),
    ("FADING", "ma5 > ma10 AND close > ma5 AND h0 < 0", "CASE WHEN turn < 0 THEN 1.0 ELSE 1.5 END"),
    ("STRUGGLE", "ma5 > ma10 AND close < ma5 AND close > ma10", 0.3),
    ("DOWN_EXTREME", "ma5 < ma10 AND close < ma5 AND h0 < 0 AND gap < -4.0 AND abs(h0) > 0.8 AND dev < -2.0", "-strength"),
    ("DOWN_STRONG", "ma5 < ma10 AND close < ma5 AND h0 < 0 AND turn < 0", "-strength * 0.85"),
    ("DOWN", "ma5 < ma10 AND close < ma5 AND h0 < 0", "-strength * 0.7"),
    ("REBOUND_STRONG", "ma5 < ma10 AND close > ma5 AND h0 < 0 AND close > ma10", 1.0),
    ("REBOUND_WEAK", "ma5 < ma10 AND close > ma5 AND h0 < 0", -1.5),
    ("BOTTOMING", "ma5 < ma10 AND close < ma5 AND h0 > 0", -0.5),
    ("FLAT_UP", "ma5 <> ma10 AND flat AND h0 > 0.2", 0.8),
    ("FLAT_DOWN", "ma5 <> ma10 AND flat AND h0 < -0.2", -0.8),
    ("FLAT", "ma5 <> ma10 AND flat", 0.0),
    ("RISING", "gap > 1.5", "least(3.0, 1.0 + abs(gap) * 0.15 + abs(h0) * 0.2) * CASE WHEN dev > 5 THEN 0.8 ELSE 1.0 END"),
    ("FALLING", "gap < -1.5", "greatest(-3.0, -1.0 - abs(gap) * 0.15 - abs(h0) * 0.2)"),
    ("LEANS_UP", "h0 > 0.2", 0.5),
    ("LEANS_DOWN", "h0 < -0.2", -0.5),
]
#: What the returns add, and what a price far above its means costs. Not applied to thin histories.
MONTH_RETURNS: Rules = [("", "ret3 > 3 AND ret6 > 5", 0.5), ("", "ret3 < -3 AND ret6 < -5", -0.5), ("", "ret3 > 2 AND ret6 < -2", 0.3), ("", "ret3 < -2 AND ret6 > 3", -0.3)]
MONTH_HEAT: Rules = [("", "dev20 > 22", 1.0), ("", "dev20 > 16", 0.6), ("", "dev > 10", 0.4)]

#: Fixed values of the weekly rules. high12, low12: of the last 12 weeks; high12p, low12p: of the 12 before the last.
WEEK_STEPS = [
    {
        "dist": "CASE WHEN ma20 > 0 THEN (close - ma20) / ma20 * 100 ELSE 0 END",
        "vr": "coalesce(volume / nullif(vma, 0), 1.0)",
        "width": "CASE WHEN low12 > 0 THEN (high12 - low12) / low12 * 100 ELSE 0 END",
        "wick": "CASE WHEN high > 0 THEN greatest(0.0, (high - greatest(open, close)) / high * 100) ELSE 0 END",
    },
    {
        "strong": "close > ma20 AND slope20 > 0.3",
        "weak": "close < ma20 AND slope20 < -0.4",
        "bull": "ma5 > ma10 AND ma10 > ma20 * 0.98",
        "bear": "ma5 < ma10 AND ma10 < ma20 * 1.02",
        "up": "slope5 > 0.4 AND slope10 > 0.2",
        "down": "slope5 < -0.4 AND slope10 < -0.2",
        "platform": "width > 0 AND width <= 13.0 AND abs(slope20) < 1.2",
        "breakout": "high12p > 0 AND close >= high12p * 0.995 AND vr >= 1.08 AND h0 > 0",
        "failed": "high12p > 0 AND high >= high12p * 0.995 AND close < high12p * 0.985 AND (wick >= 1.2 OR vr >= 1.25)",
        "near": "close > ma20 AND slope20 > 0.3 AND close <= ma10 * 1.02 AND close >= ma20 * 0.98",
    },
]
WEEK: Rules = [
    ("THIN", "ma20 IS NULL OR slope20 IS NULL", 0.0),
    ("FAILED_ABOVE", "failed AND close > ma20", 1.0),
    ("FAILED", "failed", -1.5),
    ("BREAKOUT_STRONG", "breakout AND bull AND up AND slope20 > 0.5", 6.0),
    ("BREAKOUT", "breakout", 4.8),
    ("ADVANCE", "bull AND strong AND h0 > 0 AND up AND dist <= 12.0", 5.6),
    ("ADVANCE_FAR", "bull AND strong AND h0 > 0 AND up", 4.6),
    ("PULLBACK", "near AND h0 >= -0.05 AND vr <= 1.15", 4.2),
    ("PULLBACK_WEAK", "near", 2.4),
    ("PLATFORM", "platform AND close >= ma20 * 0.98 AND h0 >= -0.05", "CASE WHEN close >= ma10 THEN 2.8 ELSE 1.6 END"),
    ("UP_FADING", "strong AND h0 < 0", 2.0),
    ("UP", "strong AND h0 > 0", 4.3),
    ("DOWN_EXTREME", "bear AND weak AND h0 < 0 AND slope20 < -0.7 AND down", -6.0),
    ("REBOUND", "weak AND h0 > 0", -2.5),
    ("DOWN", "weak AND h0 < 0", -4.8),
    ("NEAR_LOW", "weak AND low12p > 0 AND close <= low12p * 1.01", -5.2),
    ("FLAT", "abs(slope20) < 1.2 AND abs(dist) < 5.0", 0.0),
    ("LOOSE_ABOVE", "close > ma20", 0.5),
    ("LOOSE", "close <= ma20", -0.5),
]

#: Fixed values of the daily rules. high20p, low20p: of the 20 bars before the last; thick, thin: volume ratios.
DAY_STEPS = [
    {
        "upper": "ma20 + 2 * sd20",
        "lower": "ma20 - 2 * sd20",
        "vr": "coalesce(volume / nullif(vma, 0), 0.0)",
        "heat": "CASE WHEN close > 0 THEN coalesce(atr / close * 100, 0) ELSE 0 END",
        "wick": "CASE WHEN high > low THEN greatest(0.0, (high - greatest(open, close)) / (high - low)) ELSE 0 END",
        "bull": "ma5 > ma10 AND ma10 > ma20 * 0.995",
        "bear": "ma5 < ma10 AND ma10 < ma20 * 1.005",
        "lean": "CASE WHEN h0 > 0 THEN 0.3 WHEN h0 < 0 THEN -0.3 ELSE 0.0 END",
    },
    {"percent_b": "(close - lower) / nullif(upper - lower, 0)"},
]
DAY: Rules = [
    ("NO_BAND", "upper IS NULL OR ma20 <= 0", 0.0),
    ("SQUEEZE", "(upper - lower) / ma20 < 0.06", "0.5 + lean"),
    ("BREAKOUT", "close >= upper * 0.99 AND vr > 1.3", 3.0),
    ("STALLED", "close >= upper * 0.99", 0.5),
    ("WASHED_OUT", "close <= lower * 1.015 AND vr < 0.7", 2.8),
    ("BREAKDOWN", "close <= lower * 1.015", -3.0),
    ("MIDDLE_HELD", "abs((close - ma20) / ma20) < 0.015 AND h0 > 0", 1.3),
    ("MIDDLE_WEAK", "abs((close - ma20) / ma20) < 0.015 AND h0 < -0.1", -1.6),
    ("MIDDLE", "abs((close - ma20) / ma20) < 0.015", 0.0),
    ("CHANNEL", "percent_b IS NOT NULL", "greatest(-1.5, least(1.5, (percent_b - 0.5) * 2.0)) + lean"),
    ("CHANNEL_UP", "close > ma20 AND close < upper", 0.8),
    ("CHANNEL_DOWN", "close > lower AND close < ma20", -0.8),
]
#: Groups of adjustments to the daily points; of each group the first rule that holds counts.
DAY_ADJUSTMENTS: list[Rules] = [
    [("MEANS_UP", "bull AND close > ma5", 0.4), ("MEANS_PULLBACK", "bull AND close >= ma10 * 0.99", 0.2), ("MEANS_DOWN", "bear AND close < ma10", -0.5)],
    [
        ("HIGH_CONFIRMED", "high20p > 0 AND close >= high20p * 0.998 AND vr >= 1.3 AND wick < 0.35", 0.6),
        ("HIGH_UNCONFIRMED", "high20p > 0 AND close >= high20p * 0.998", -0.5),
        ("LOW_ON_VOLUME", "low20p > 0 AND close <= low20p * 1.002 AND vr > 1.1", -0.7),
        ("LOW_ON_LITTLE", "low20p > 0 AND close <= low20p * 1.002", -0.2),
    ],
    [("REJECTED", "high20p > 0 AND high >= high20p * 0.998 AND close < high20p * 0.99 AND wick >= 0.35", -0.8)],
    [("MIDDLE_LOST", "previous >= ma20 AND close < ma20", -0.6), ("MIDDLE_REGAINED", "previous <= ma20 AND close > ma20 AND h0 > 0", 0.3)],
    [("RANGE_HOT", "heat > 4.5 AND close > upper * 0.98", -0.4), ("RANGE_HEALTHY", "heat >= 1.0 AND heat <= 3.5 AND base > 0", 0.2)],
    [("OVERBOUGHT", "rsi > 75", -0.5), ("OVERSOLD", "rsi < 25", 0.4)],
    [
        ("EXPANDING_UP", "h2 > 0 AND h1 > 0 AND h0 > 0 AND h2 > h3 AND h1 > h2 AND h0 > h1", 0.3),
        ("EXPANDING_DOWN", "h2 < 0 AND h1 < 0 AND h0 < 0 AND h2 < h3 AND h1 < h2 AND h0 < h1", -0.3),
        ("SHRINKING_UP", "h0 > 0 AND h0 < h1", -0.1),
        ("SHRINKING_DOWN", "h0 < 0 AND h0 > h1", 0.1),
    ],
    [("PRICE_WITHOUT_VOLUME", "price_slope > 0 AND volume_slope < 0", -0.4), ("FALL_ON_VOLUME", "price_slope < 0 AND volume_slope > 0", -0.3)],
    [
        ("TOP_DIVERGENCE", "bars >= 25 AND high_z > high_a AND high_z_h < high_a_h AND high_z_h > 0 AND high_z_at > 3", -0.5),
        ("BOTTOM_DIVERGENCE", "bars >= 25 AND low_z < low_a AND low_z_h > low_a_h AND low_z_h < 0 AND low_z_at > 3", 0.5),
    ],
]


def points(rules: Rules, otherwise: float = 0.0) -> str:
    """The points of the first rule that holds, as an expression of either engine."""
    return "CASE " + " ".join(f"WHEN {condition} THEN CAST({value} AS DOUBLE)" for _, condition, value in rules) + f" ELSE CAST({otherwise} AS DOUBLE) END"


def names(rules: Rules, otherwise: str) -> str:
    """The name of the first rule that holds."""
    return "CASE " + " ".join(f"WHEN {condition} THEN '{name}'" for name, condition, _ in rules) + f" ELSE '{otherwise}' END"


def steps(unit: str) -> list[dict[str, str]]:
    """Expressions that lead from the inputs of a unit (month, week, day) to rule, score and, for days, tags."""
    if unit == "week":
        return [*WEEK_STEPS, {"rule": names(WEEK, "THIN"), "score": points(WEEK)}]
    if unit == "month":
        total = "round(greatest(-5.0, least(5.0, base + bonus - heat)) + 1e-7, 1)"
        return [
            *MONTH_STEPS,
            {"rule": names(MONTH, "SIDEWAYS"), "base": points(MONTH), "bonus": points(MONTH_RETURNS), "heat": points(MONTH_HEAT)},
            {"score": f"CASE WHEN rule LIKE 'THIN%' THEN base ELSE {total} END"},
        ]
    tags = ", ".join(f"nullif({names(group, '')}, '')" for group in DAY_ADJUSTMENTS)
    return [
        *DAY_STEPS,
        {"rule": names(DAY, "SIDEWAYS"), "base": points(DAY)},
        {"adjustment": " + ".join(points(group) for group in DAY_ADJUSTMENTS), "all_tags": f"concat_ws(',', {tags})"},
        {"score": "CASE WHEN rule = 'NO_BAND' THEN CAST(0 AS DOUBLE) ELSE round(greatest(-5.0, least(5.0, base + adjustment)) + 1e-7, 1) END", "tags": "CASE WHEN rule = 'NO_BAND' THEN '' ELSE all_tags END"},
    ]


def scored(inputs: DataFrame, unit: str) -> DataFrame:
    """Add rule and score (for days also tags) to rows of inputs; what a row has no history for is null."""
    for step in steps(unit):
        inputs = inputs.withColumns({k: F.expr(e) for k, e in step.items()})
    return inputs


def _tail(column: str, n: int, back: int = 0) -> Column:
    """The n values of an array that end back values before its end; null if it is shorter."""
    a = F.col(column)
    return F.when(F.size(a) >= n + back, F.slice(a, F.greatest(F.size(a) - (n + back) + 1, F.lit(1)), n))


def _mean(column: str, n: int, back: int = 0) -> Column:
    return F.aggregate(_tail(column, n, back), F.lit(0.0), lambda acc, x: acc + x) / n


def _at(column: str, back: int) -> Column:
    return F.get(column, F.size(column) - 1 - back)


def _momentum() -> Column:
    """Fold of the closes c: the last SPAN histograms (12/26/9), oldest first, and the Wilder means of gains and losses."""
    first = F.get("c", 0)
    start = F.struct(first.alias("fast"), first.alias("slow"), F.lit(0.0).alias("dea"), first.alias("before"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array(F.lit(0.0)).alias("hist"))

    def step(acc, x):
        fast, slow = acc["fast"] * (1 - 2 / 13) + x * (2 / 13), acc["slow"] * (1 - 2 / 27) + x * (2 / 27)
        dea = acc["dea"] * (1 - 2 / 10) + (fast - slow) * (2 / 10)
        up = acc["up"] * (1 - 1 / 14) + F.greatest(x - acc["before"], F.lit(0.0)) * (1 / 14)
        down = acc["down"] * (1 - 1 / 14) + F.greatest(acc["before"] - x, F.lit(0.0)) * (1 / 14)
        kept = F.slice(acc["hist"], F.greatest(F.size(acc["hist"]) - SPAN + 2, F.lit(1)), SPAN - 1)
        hist = F.concat(kept, F.array(F.round(fast - slow - dea, 9)))
        return F.struct(fast.alias("fast"), slow.alias("slow"), dea.alias("dea"), x.alias("before"), up.alias("up"), down.alias("down"), hist.alias("hist"))

    return F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), start, step)


def inputs(bars: DataFrame, unit: str) -> DataFrame:
    """One row an instrument with what the rules of a unit read, at its last bar. bars: code, date, open to close, volume."""
    short = {"open": "o", "high": "hi", "low": "lo", "close": "c", "volume": "v"}
    h = E.histories(bars, *short).withColumns({to: E.values(column) for column, to in short.items()}).withColumn("x", _momentum())
    h = h.withColumns({"date": F.get("h", F.size("h") - 1)["date"], "bars": F.size("h"), "hist": F.col("x.hist")})
    h = h.withColumns({column: _at(to, 0) for column, to in short.items()})
    h = h.withColumns({f"h{k}": _at("hist", k) for k in range(4)} | {f"ma{n}": _mean("c", n) for n in (5, 10, 20)} | {f"was{n}": _mean("c", n, 3) for n in (5, 10, 20)})
    h = h.withColumns({f"slope{n}": F.try_divide(F.col(f"ma{n}") - F.col(f"was{n}"), F.col(f"was{n}")) * 100 for n in (5, 10, 20)} | {"vma": _mean("v", 20)})
    if unit == "month":
        return h.withColumns({"close3": _at("c", 3), "close6": _at("c", 6)})
    if unit == "week":
        return h.withColumns({"high12": F.array_max(_tail("hi", 12)), "low12": F.array_min(_tail("lo", 12)), "high12p": F.array_max(_tail("hi", 12, 1)), "low12p": F.array_min(_tail("lo", 12, 1))})
    ranges = F.transform("c", lambda x, i: F.when(i == 0, F.get("hi", i) - F.get("lo", i)).otherwise(F.greatest(F.get("hi", i), F.get("c", i - 1)) - F.least(F.get("lo", i), F.get("c", i - 1))))
    square = lambda acc, x: acc + (x - F.col("ma20")) * (x - F.col("ma20"))
    slope = lambda column: sum((_at(column, k) * (5 - 2 * k) for k in range(1, 6)), _at(column, 0) * 5)
    h = h.withColumns({"tr": ranges, "sd20": F.sqrt(F.aggregate(_tail("c", 20), F.lit(0.0), square) / 19), "half": F.floor(F.size("hist") / 2).cast("int")})
    h = h.withColumns({"atr": _mean("tr", 14), "previous": _at("c", 1), "high20p": F.array_max(_tail("hi", 20, 1)), "low20p": F.array_min(_tail("lo", 20, 1)), "price_slope": slope("c"), "volume_slope": slope("v")})
    h = h.withColumn("rsi", F.when(F.col("x.down") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("x.up"), F.col("x.down")))))
    h = h.withColumn("last", F.slice("c", F.greatest(F.size("c") - F.size("hist") + 1, F.lit(1)), SPAN))
    parts = {"a": lambda c: F.slice(c, F.lit(1), F.col("half")), "z": lambda c: F.slice(c, F.col("half") + 1, SPAN)}
    for name, part in parts.items():
        for kind, pick in (("high", F.array_max), ("low", F.array_min)):
            at = F.array_position(part("last"), pick(part("last"))).cast("int")
            h = h.withColumns({f"{kind}_{name}": pick(part("last")), f"{kind}_{name}_at": at, f"{kind}_{name}_h": F.get(part("hist"), at - 1)})
    return h
