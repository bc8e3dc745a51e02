"""Search of factor expressions: evolution, diversity, and sets that complement one another.

The driver holds expressions and a few numbers for each; every generation or family of sets is evaluated as one job
over the panel, in which each candidate is a column and each (candidate, date) its own cross-section.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import expressions as X
from panelmill.operators import crosssection as S

#: Weights of the fitness, and the gates of sets.
FITNESS = {"ic_mean": 1.0, "ic_ir": 0.015, "recent_mean": 0.020, "turnover": -0.020}
COMPLEXITY, MOST_CORRELATION, LEAST_WEIGHT, LEAST_GAIN = 0.0008, 0.95, 0.05, 0.0005
UNARY, BINARY = ("neg", "abs", "signed_sqrt"), ("add", "sub", "mul", "div", "min", "max")


def evaluate(rows: DataFrame, candidates: dict[str, Column], recent: int = 26) -> list[dict]:
    """Summary of rank correlations with ``forward`` and turnover of each candidate column, in one pass over rows (date, code, forward, ...)."""
    long = rows.select("date", "code", "forward", F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.round(c, 9).alias("value")) for k, c in candidates.items()])).alias("f"))
    long = long.select(F.struct("date", "f.factor").alias("date"), "code", "forward", "f.value")
    ic = S.rank_ic(long, "value", "forward").select("date.factor", "date.date", "ic")
    held = long.withColumn("rk", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "code"))).withColumn("k", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("date")) * 0.25)).where("rk <= k")
    dates = rows.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))  # one row a date
    held = held.select("date.factor", "date.date", "code", (1 / F.col("k")).alias("w")).join(dates, "date").select("factor", "code", "t", "w")
    moved = held.unionByName(held.select("factor", "code", (F.col("t") + 1).alias("t"), (-F.col("w")).alias("w"))).groupBy("factor", "t", "code").agg(F.sum("w").alias("d"))
    change = moved.groupBy("factor", "t").agg((F.sum(F.abs("d")) / 2).alias("v")).join(dates.where("t > 1").select("t"), "t").groupBy("factor").agg(F.round(F.avg("v"), 6).alias("turnover"))
    return [r.asDict() for r in S.ic_summary(ic, recent).join(change, "factor").collect()]  # a row a candidate


def fitness(found: dict, complexity: int) -> float:
    return round(sum(w * (found[k] or 0.0) for k, w in FITNESS.items()) - COMPLEXITY * complexity, 8)


def random_tree(rng: random.Random, features: list[str], depth: int = 3) -> X.Tree:
    if depth == 0 or (depth < 3 and rng.random() < 0.3):
        return rng.choice(features)
    if rng.random() < 0.2:
        return (rng.choice(UNARY), random_tree(rng, features, depth - 1))
    return (rng.choice(BINARY), random_tree(rng, features, depth - 1), random_tree(rng, features, depth - 1))


def offspring(rng: random.Random, elite: list[X.Tree], features: list[str]) -> X.Tree:
    a = rng.choice(elite)
    if rng.random() < 0.55:
        return (rng.choice(BINARY), a, rng.choice(elite))
    draw = rng.random()
    return (rng.choice(BINARY), a, rng.choice(features)) if draw < 0.45 else (rng.choice(UNARY), a) if draw < 0.85 else random_tree(rng, features)


def evolve(rows: DataFrame, features: list[str], population: int = 32, generations: int = 5, seed: int = 42) -> list[dict]:
    """Candidates, fittest first: expression, fitness, generation and the summary. Each generation is one job.

    A candidate with a negative mean is negated; the rank correlation of the negated column is the negative one, so it
    needs no second evaluation (its turnover is that of the column as evaluated).
    """
    rng, scored = random.Random(seed), {}
    scaled = rows.withColumns({f"z_{c}": F.round(S.zscore(c), 9) for c in features})
    current = [*features][:population]
    while len(current) < population:
        current.append(random_tree(rng, features))
    for generation in range(generations):
        fresh = {X.text(t): t for t in current if not X.problems(t, set(features)) and X.text(t) not in scored}
        if fresh:
            for found in sorted(evaluate(scaled, {k: X.column(t, lambda n: F.col(f"z_{n}")) for k, t in fresh.items()}), key=lambda r: r["factor"]):
                tree = fresh[found["factor"]]
                if (found["ic_mean"] or 0.0) < 0:
                    tree, found = ("neg", tree), found | {k: -(found[k] or 0.0) for k in ("ic_mean", "ic_ir", "ic_t", "recent_mean")}
                scored[found["factor"]] = {"expression": X.text(tree), "tree": tree, "generation": generation, "fitness": fitness(found, X.nodes(tree)), **found}
        ranked = sorted(scored.values(), key=lambda r: (-r["fitness"], r["expression"]))
        elite = [r["tree"] for r in ranked[: max(4, population // 4)]]
        current, tries = list(elite), 0
        while len(current) < population and tries < 50 * population:
            child, tries = offspring(rng, elite, features), tries + 1
            if not X.problems(child, set(features)):
                current.append(child)
    best: dict[str, dict] = {}
    for r in ranked:
        best.setdefault(r["expression"], r)
    return list(best.values())


def diverse(ordered: list[str], duplicates: set[tuple[str, str]]) -> list[str]:
    """The names, best first, that no earlier kept name duplicates."""
    kept: list[str] = []
    for name in ordered:
        if not any((name, k) in duplicates or (k, name) in duplicates for k in kept):
            kept.append(name)
    return kept


def complementary_sets(rows: DataFrame, features: list[str], largest: int = 3, ridge: float = 2.0) -> list[dict]:
    """Sets of 2 to ``largest`` features, best first: weights, metrics, gain over the best single one, and why a set fails.

    One aggregate gives every moment that all sets need; the weights of each set are solved from it (non-negative, then
    normalised). One more job evaluates all sets and single features.
    """
    scaled = rows.withColumns({f"z_{c}": F.round(S.zscore(c), 9) for c in features})
    names = [f"z_{c}" for c in features] + ["forward"]
    pairs = list(itertools.combinations_with_replacement(names, 2))
    got = scaled.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"m{i}") for i, (a, b) in enumerate(pairs)]).first()
    if not got["n"]:
        return []
    moment = {frozenset(p): (got[f"m{i}"] or 0.0) / got["n"] for i, p in enumerate(pairs)}
    gram = lambda a, b: moment[frozenset((f"z_{a}", b if b == "forward" else f"z_{b}"))]
    sets, columns = {}, {c: F.col(f"z_{c}") for c in features}
    for size in range(2, min(largest, len(features)) + 1):
        for chosen in itertools.combinations(features, size):
            g = np.array([[gram(a, b) for b in chosen] for a in chosen])
            spread = np.sqrt(np.maximum(np.diag(g), 1e-12))
            correlation = np.abs(g / np.outer(spread, spread))[np.triu_indices(size, 1)].max()
            solved = np.maximum(np.linalg.solve(g + ridge / 100 * np.eye(size), np.array([gram(a, "forward") for a in chosen])), 0.0)
            weights = solved / (solved.sum() or 1.0)
            reasons = [r for r, bad in (("REDUNDANT", correlation >= MOST_CORRELATION or 1 - correlation**2 < 0.10), ("FEWER_THAN_TWO_WEIGHTS", (weights >= LEAST_WEIGHT).sum() < 2)) if bad]
            name = "+".join(chosen)
            sets[name] = {"set": name, "members": list(chosen), "weights": [round(float(w), 6) for w in weights], "reasons": reasons}
            columns[name] = sum((float(w) * F.col(f"z_{c}") for c, w in zip(chosen, weights, strict=True)), F.lit(0.0))
    found = {r["factor"]: r for r in evaluate(scaled, columns)}
    for s in sets.values():
        mine = found.get(s["set"])
        single = max((found[c]["ic_mean"] or 0.0 for c in s["members"] if c in found), default=0.0)
        s |= {k: (mine[k] or 0.0) if mine else 0.0 for k in ("ic_mean", "ic_ir", "turnover")}
        s["gain"] = round(s["ic_mean"] - single, 8)
        s["score"] = round(s["ic_mean"] + 0.01 * s["ic_ir"] - 0.02 * s["turnover"] - 0.001 * (len(s["members"]) - 2), 8)
        if s["ic_mean"] < 0.01 or s["ic_ir"] < 0.10 or s["turnover"] > 0.90:
            s["reasons"].append("METRIC_GATE")
        if s["gain"] < LEAST_GAIN:
            s["reasons"].append("NO_GAIN")
    return sorted(sets.values(), key=lambda s: (len(s["reasons"]) > 0, -s["score"], s["set"]))
