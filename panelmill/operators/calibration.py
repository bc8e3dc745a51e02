"""Three heads over the calibration panel, fitted for every expanding fold at once.

Heads: chance of an early stop, chance of a gain (L2 logistic) and expected excess (ridge on the cut label). A fold trains on all rows before its
end, so rows fall into segments between the ends, and a fold's sums are those of the segments up to its own. One aggregate by
segment therefore gives the means, scales and normal equations of all folds as prefix sums: the excess head is solved from
them, and the chances start from their least-squares lines. Each Newton step is one more pass that sums the moments of all folds and both heads;
a task returns one small matrix a fold and head, whatever its rows. Only such sums reach the driver.

Defined results: a null feature or excess counts as 0 and a null chance label as 0; rows with a null date belong to no fold; a fold without
training rows has no model; a feature that does not vary has scale 1; an empty panel gives no model and no prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators import governance as G

#: Inputs of the heads, and where the excess is cut.
FEATURES = ["f_monthly", "f_weekly", "f_setup", "f_relative", "f_risk", "f_market", "f_breakout", "f_adaptive"]
MOST_EXCESS = 0.15
CHANCES = ["early_stop", "win"]
Fold = tuple[int, date, date, date, date]


@dataclass
class FoldModel:
    """Means and scales of the features and the weights of the heads (intercept first)."""

    fold: int
    rows: int
    mean: np.ndarray
    scale: np.ndarray
    heads: dict[str, np.ndarray]


def segments(rows: DataFrame, folds: list[Fold], features: list[str]) -> DataFrame:
    """segment (the first fold that trains on the row), x (1 and the features), y (both chance labels and the cut excess)."""
    ends, begin = [f[2] for f in folds], folds[0][1]
    segment = sum((F.when(F.col("date") >= F.lit(end), 1).otherwise(0) for end in ends), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cut = F.greatest(F.lit(-MOST_EXCESS), F.least(F.lit(MOST_EXCESS), zero("excess_10d")))
    data = rows.where(F.col("date") >= F.lit(begin)).select(segment.alias("segment"), F.array(F.lit(1.0), *[zero(c) for c in features]).alias("x"), F.array(zero("early_stop"), zero("win_10d"), cut).alias("y"))
    return data.where(F.col("segment") < len(folds))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    arrays = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "y")]
    return batch.column("segment").to_numpy(), *arrays


def _cells(group: int, sums: np.ndarray) -> pa.RecordBatch:
    i, j = np.divmod(np.arange(sums.size), sums.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(np.full(sums.size, group, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums.ravel())], ["g", "i", "j", "value"])


def _summed(data: DataFrame, each, groups: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of each(batches), which yields (group, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, matrix in each(batches):
            yield _cells(group, matrix)

    out = np.zeros((groups, *shape))
    found = data.mapInArrow(run, "g int, i int, j int, value double").groupBy("g", "i", "j").agg(F.sum("value").alias("value")).toArrow()
    out[tuple(found.column(c).to_numpy() for c in ("g", "i", "j"))] = found.column("value").to_numpy()
    return out


def prefix_moments(data: DataFrame, folds: int, width: int) -> np.ndarray:
    """For each fold the products of all pairs of 1, the features and the three labels, summed over its training rows."""
    size = width + 4

    def each(batches):
        sums = np.zeros((folds, size, size))
        for batch in batches:
            segment, x, y = _columns(batch)
            z = np.hstack((x, y))
            for s in np.unique(segment):
                part = z[segment == s]
                sums[s] += part.T @ part
        yield from enumerate(sums)

    return np.cumsum(_summed(data, each, folds, (size, size)), axis=0)


def fit_heads(rows: DataFrame, folds: list[Fold], features: list[str] = FEATURES, ridge: float = 1.0, rounds: int = 80, tolerance: float = 1e-7) -> list[FoldModel]:
    """One model a fold. rows: date, the features, early_stop, win_10d, excess_10d."""
    if not folds:
        return []
    data, width = segments(rows, folds, features).persist(), len(features)
    moments = prefix_moments(data, len(folds), width)
    penalty, models = np.diag([0.0, *[ridge] * width]), []
    for fold, m in zip(folds, moments, strict=True):
        n = m[0, 0]
        if not n:
            continue
        mean = m[0, 1 : width + 1] / n
        spread = np.sqrt(np.maximum(np.diag(m)[1 : width + 1] / n - mean**2, 0.0))
        scale = np.where(spread < 1e-8, 1.0, spread)
        # z = T x with x = (1, features): the moments of standardised columns are T M T'.
        turn = np.diag([1.0, *(1 / scale)])
        turn[1:, 0] = -mean / scale
        gram, sides = turn @ m[: width + 1, : width + 1] @ turn.T, turn @ m[: width + 1, width + 1 :]
        lines = np.linalg.solve(gram + penalty, sides)
        # A line through chances around one half is about a quarter of a logit's slope.
        start = np.vstack([4 * (lines[:, k] - 0.5 * np.eye(width + 1)[0]) for k in range(2)])
        models.append(FoldModel(fold[0], int(n), mean, scale, {"excess": lines[:, 2], **dict(zip(CHANCES, start, strict=True))}))
    _newton(data, models, {f[0]: i for i, f in enumerate(folds)}, penalty, rounds, tolerance)
    data.unpersist()
    return models


def _newton(data: DataFrame, models: list[FoldModel], place: dict[int, int], penalty: np.ndarray, rounds: int, tolerance: float) -> None:
    """Newton's steps of both chances of all folds; a fold's head that has converged takes part no more."""
    size = len(penalty)
    todo = [(m, k) for m in models for k in range(2)]
    least, last = dict.fromkeys(((m.fold, k) for m, k in todo), np.inf), {}
    for _ in range(rounds):
        if not todo:
            return
        work = [(place[m.fold], k, m.mean, m.scale, m.heads[CHANCES[k]]) for m, k in todo]

        def each(batches, work=work):
            sums = np.zeros((len(work), size + 2, size))
            for batch in batches:
                segment, x, y = _columns(batch)
                for at, (fold, k, mean, scale, weights) in enumerate(work):
                    mine = segment <= fold
                    z = x[mine].copy()
                    z[:, 1:] = (z[:, 1:] - mean) / scale
                    logit = np.clip(z @ weights, -G.LOGIT, G.LOGIT)
                    p = 1 / (1 + np.exp(-logit))
                    sums[at, :size] += (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
                    sums[at, size] += z.T @ (y[mine, k] - p)
                    sums[at, size + 1, 0] += (np.logaddexp(0, logit) - y[mine, k] * logit).sum()
            yield from enumerate(sums)

        open_ = []
        for (m, k), s in zip(todo, _summed(data, each, len(work), (size + 2, size)), strict=True):
            weights = m.heads[CHANCES[k]]
            loss = s[size + 1, 0] + weights @ penalty @ weights / 2
            if loss > least[m.fold, k] * (1 + 1e-9) + 1e-9:
                # The last step went too far: take half of it back.
                last[m.fold, k] = last[m.fold, k] / 2
                m.heads[CHANCES[k]] = weights - last[m.fold, k]
                open_.append((m, k))
                continue
            least[m.fold, k] = loss
            move = np.linalg.solve(s[:size] + penalty, s[size] - penalty @ weights)
            m.heads[CHANCES[k]] = weights + move
            last[m.fold, k] = move
            if np.abs(move).max() >= tolerance:
                open_.append((m, k))
        todo = open_


def model_rows(models: list[FoldModel], features: list[str] = FEATURES) -> list[tuple]:
    """(fold, samples, head, term, weight), the intercept first."""
    return [(m.fold, m.rows, head, term, float(np.round(w, 6))) for m in models for head, weights in sorted(m.heads.items()) for term, w in zip(["intercept", *features], weights, strict=True)]


def predict_folds(rows: DataFrame, folds: list[Fold], models: list[FoldModel], features: list[str] = FEATURES) -> DataFrame:
    """The rows of each fold's validation part with fold, samples, early_stop_chance, win, excess and confidence of that fold's model.

    Validation parts do not overlap, so a row has one fold at most; weights are literals, a few a fold.
    """
    by_fold = {m.fold: m for m in models}
    out = None
    for number, _, _, begin, end in folds:
        if (m := by_fold.get(number)) is None:
            continue
        part = rows.where((F.col("date") >= F.lit(begin)) & (F.col("date") < F.lit(end)))
        head = lambda name, m=m: G.linear(features, m.mean.tolist(), m.scale.tolist(), m.heads[name].tolist())
        part = part.withColumns({"fold": F.lit(number), "samples": F.lit(m.rows), "early_stop_chance": F.round(G.sigmoid(head("early_stop")), 6), "win": F.round(G.sigmoid(head("win")), 6), "excess": F.round(head("excess"), 8)})
        part = part.withColumn("confidence", F.expr(G.CONFIDENCE))
        out = part if out is None else out.unionByName(part)
    if out is None:
        nothing = {"fold": "int", "samples": "int", "early_stop_chance": "double", "win": "double", "excess": "double", "confidence": "string"}
        return rows.where(F.lit(False)).withColumns({k: F.lit(None).cast(t) for k, t in nothing.items()})
    return out
