"""Forward labels, walk-forward folds, threshold grids and small learners."""

from __future__ import annotations

import itertools
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.functions import costs
from panelmill.functions.windows import by_code

NOTIONAL = 100_000.0


def forward_labels(bars: DataFrame, bench: DataFrame, stop_share: float = 0.95) -> DataFrame:
    """Entry at the next session's open, exits at the close 5, 10 and 20 sessions after entry, with costs.

    bars: code, date, open, low, close, amount; bench: date, bench. The benchmark is joined on the
    instrument's own led dates, so no range join is needed. Label costs use the amount of the 20
    sessions after the signal, which only a label may know.
    """
    rows = bars.join(bench, "date", "left")
    ahead = lambda c, n: F.lead(c, n).over(by_code())
    rows = rows.withColumns(
        {
            "entry_open": ahead("open", 1),
            "entry_date": ahead("date", 1),
            "bench_entry": ahead("bench", 1),
            "adv": F.avg("amount").over(by_code().rowsBetween(1, 20)),
            "low3": F.min("low").over(by_code().rowsBetween(1, 3)),
            "low20": F.min("low").over(by_code().rowsBetween(1, 20)),
            **{f"close_{h}": ahead("close", h + 1) for h in (5, 10, 20)},
            **{f"bench_{h}": ahead("bench", h + 1) for h in (5, 10, 20)},
        }
    ).where(F.col("close_10").isNotNull() & (F.col("entry_open") > 0))
    shares = F.greatest(F.lit(NOTIONAL) / F.col("entry_open"), F.lit(1.0))
    rows = rows.withColumn("shares", shares).withColumn("entry", costs.estimate(F.lit("BUY"), F.col("entry_open"), F.col("shares"), F.col("adv"))["effective_price"])
    out = [F.col("code"), F.col("date"), F.col("entry_date"), F.round("entry", 6).alias("entry_price"), (F.col("low3") <= F.col("close") * stop_share).cast("int").alias("early_stop")]
    for h in (5, 10, 20):
        exit_ = costs.estimate(F.lit("SELL"), F.col(f"close_{h}"), F.col("shares"), F.col("adv"))["effective_price"]
        own = F.when(F.col(f"close_{h}").isNotNull(), exit_ / F.col("entry") - 1).otherwise(0.0)
        market = F.when(F.col(f"close_{h}").isNotNull(), F.col(f"bench_{h}") / F.col("bench_entry") - 1).otherwise(0.0)
        out += [F.round(own, 6).alias(f"return_{h}d"), F.round(own - market, 6).alias(f"excess_{h}d")]
    return rows.select(*out, F.round(F.col("low20") / F.col("entry") - 1, 6).alias("adverse"))


def _months(day: date, n: int) -> date:
    y, m = divmod(day.year * 12 + day.month - 1 + n, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m + 1, min(day.day, last))


def business_days(day: date, n: int) -> date:
    step = 1 if n > 0 else -1
    while n:
        day += timedelta(days=step)
        if day.weekday() < 5:
            n -= step
    return day


def walk_forward_folds(first: date, last: date, train: int = 24, validate: int = 6, step: int = 6, purge: int = 20, embargo: int = 5) -> list[tuple[int, date, date, date, date]]:
    """(fold, train_start, train_end, validate_start, validate_end): expanding training, purged before and embargoed behind."""
    folds, start = [], _months(first, train)
    while _months(start, validate) <= last:
        folds.append((len(folds), first, business_days(start, -purge), start, _months(start, validate)))
        start = business_days(_months(start, step), embargo)
    return folds


def fold_report(spark: SparkSession, rows: DataFrame, folds: list) -> DataFrame:
    """Rows, first and last date of each fold's training and validation part.

    Folds are a dozen rows made from two dates; each panel row looks its parts up in that list by a
    higher-order filter, so rows are never joined with ranges.
    """
    made = F.array(*[F.struct(F.lit(f[0]).alias("fold"), *[F.lit(d).alias(k) for k, d in zip(("a", "b", "c", "d"), f[1:], strict=True)]) for f in folds])
    training = F.transform(F.filter(made, lambda x: (F.col("date") >= x["a"]) & (F.col("date") < x["b"])), lambda x: F.struct(x["fold"].alias("fold"), F.lit("train").alias("part")))
    validating = F.transform(F.filter(made, lambda x: (F.col("date") >= x["c"]) & (F.col("date") < x["d"])), lambda x: F.struct(x["fold"].alias("fold"), F.lit("validate").alias("part")))
    long = rows.select("date", F.explode(F.concat(training, validating)).alias("p"))
    return long.groupBy("p.fold", "p.part").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def threshold_grid(rows: DataFrame, steps: dict[str, tuple], sums: dict[str, Column]) -> DataFrame:
    """Sums over the rows that reach every threshold of a combination, for all combinations of steps (column -> rising thresholds).

    A row falls into one cell (how many thresholds of each column it reaches), so all rows are aggregated once; the few cells then add up to the combinations
    that they reach. A combination that no row reaches has 0 rows and null sums. Columns: t0, t1, ..., kept and the sums.
    """
    spark, names = rows.sparkSession, list(steps)
    reached = [sum((F.when(F.col(c) >= t, 1).otherwise(0) for t in steps[c]), F.lit(0)).alias(f"c{i}") for i, c in enumerate(names)]
    cells = rows.groupBy(*reached).agg(F.count(F.lit(1)).alias("kept"), *[F.sum(v).alias(k) for k, v in sums.items()])
    for i, c in enumerate(names):
        # Of a column's thresholds, a cell reaches the first so many.
        cells = cells.withColumn(f"t{i}", F.explode(F.slice(F.array(*[F.lit(float(t)) for t in steps[c]]), F.lit(1), F.col(f"c{i}"))))
    keys = [f"t{i}" for i in range(len(names))]
    found = cells.groupBy(*keys).agg(F.sum("kept").alias("kept"), *[F.sum(k).alias(k) for k in sums])
    whole = spark.createDataFrame([tuple(map(float, g)) for g in itertools.product(*steps.values())], ", ".join(f"{k} double" for k in keys))
    return whole.join(found, keys, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 80, tolerance: float = 1e-7) -> np.ndarray:
    """L2 logistic regression by reweighted least squares; the intercept (first) is free."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0.0
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < tolerance:
            break
    return w


def fit_by_group(rows: DataFrame, group: str, features: list[str], label: str, ridge: float = 1.0, rounds: int = 80, tolerance: float = 1e-7) -> DataFrame:
    """One logistic fit a group. Each Newton step is one aggregate of all groups' weighted moments; the driver solves one small system a group."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[group]
    facts = rows.groupBy(group).agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).collect()
    names = ["x0", *[f"x{i + 1}" for i in range(len(features))]]
    scale = spark.createDataFrame([(r[group], *[float(r[f"{k}_{c}"]) for c in features for k in ("mean", "sd")]) for r in facts], f"{group} {kind}, " + ", ".join(f"{k}_{i} double" for i in range(len(features)) for k in ("mean", "sd")))
    # One row a group was just collected, so the scale and the weights are as small as that.
    z = [((F.col(c) - F.col(f"mean_{i}")) / F.when(F.col(f"sd_{i}") < 1e-9, 1.0).otherwise(F.col(f"sd_{i}"))).alias(f"x{i + 1}") for i, c in enumerate(features)]
    data = rows.join(F.broadcast(scale), group).select(group, F.lit(1.0).alias("x0"), *z, F.col(label).cast("double").alias("y")).persist()
    weights = {r[group]: np.zeros(len(names)) for r in facts}
    open_, penalty = set(weights), np.array([0.0, *[ridge] * len(features)])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(g, *map(float, weights[g])) for g in open_], f"{group} {kind}, " + ", ".join(f"w{i} double" for i in range(len(names))))
        score = sum((F.col(f"w{i}") * F.col(x) for i, x in enumerate(names)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), score))))
        step = data.join(F.broadcast(now), group).withColumn("p", p).withColumn("h", F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-6)))
        sums = step.groupBy(group).agg(*[F.sum(F.col("h") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs], *[F.sum(F.col(x) * (F.col("y") - F.col("p"))).alias(x) for x in names])
        for r in sums.collect():
            gram = np.array([[r[f"{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"] for b in names] for a in names])
            move = np.linalg.solve(gram + np.diag(penalty), np.array([r[x] for x in names]) - penalty * weights[r[group]])
            weights[r[group]] = weights[r[group]] + move
            if np.abs(move).max() < tolerance:
                open_.discard(r[group])
    data.unpersist()
    out = [(g, term, float(np.round(v, 6))) for g, w in sorted(weights.items()) for term, v in zip(["intercept", *features], w, strict=True)]
    return spark.createDataFrame(out, f"{group} {kind}, term string, weight double")


def ridge_weights(rows: DataFrame, features: list[str], label: str, half_life: float = 52.0, ridge: float = 2.0, most: float = 0.15) -> DataFrame:
    """Recency-weighted non-negative ridge on standardised features: (term, weight), the intercept first.

    Weights halve every half_life dates and have mean 1; the label is cut at +-most, null counts as 0; the
    intercept is not penalised. Negative coefficients become 0; if none is left, all are equal. The moments
    are one distributed aggregate, the system of a few terms is solved on the driver.
    """
    dates = rows.select("date").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)  # one row a date
    facts = rows.agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    if facts[f"mean_{features[0]}"] is None:
        return rows.sparkSession.createDataFrame([], "term string, weight double")
    z = {c: F.coalesce((F.col(c) - facts[f"mean_{c}"]) / (facts[f"sd_{c}"] if facts[f"sd_{c}"] >= 1e-8 else 1.0), F.lit(0.0)) for c in features}
    cut = F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.col(label), F.lit(0.0))))
    weighted = rows.join(dates, "date").select(F.pow(F.lit(0.5), F.col("age") / half_life).alias("w"), F.lit(1.0).alias("x0"), *[v.alias(f"x{i + 1}") for i, v in enumerate(z.values())], cut.alias("y"))
    names = ["x0", *[f"x{i + 1}" for i in range(len(features))], "y"]
    got = weighted.agg(F.avg("w").alias("mean_w"), *[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    moment = np.array([[got[f"{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"] for b in names] for a in names]) / max(got["mean_w"], 1e-8)
    penalty = np.diag([0.0, *[ridge] * len(features)])
    solved = np.maximum(np.linalg.solve(moment[:-1, :-1] + penalty, moment[:-1, -1])[1:], 0.0)
    if not (solved > 1e-10).any():
        solved = np.full(len(features), 1 / len(features))
    intercept = (moment[0, -1] - moment[0, 1:-1] @ solved) / moment[0, 0]
    out = [("intercept", intercept), *zip(features, solved, strict=True)]
    return rows.sparkSession.createDataFrame([(t, float(np.round(v, 8))) for t, v in out], "term string, weight double")
