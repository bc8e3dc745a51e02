"""Embedding whitening by Chebyshev-filtered subspace iteration.

Each entry c of a vector becomes the long floor(64 * c) + OFFSET. The covariance V of the distinct vectors is never
formed: a pass multiplies it with a block of directions Q, V Q = sum over vectors of (x - mean)' ((x - mean) Q) / n, on
Spark. The vectors are centred before multiplying, by the whole part of the mean (exactly) and then by its rest, so the
large offset costs no digits. A round damps the unwanted end of the spectrum by a Chebyshev polynomial of V (DEGREE - 1 passes),
makes the block orthonormal by QR, and takes the best directions in it by Rayleigh-Ritz (one pass). Rounds go on until
the residuals |V u - e u| of all wanted components are below TOLERANCE of the largest eigenvalue, which certifies each
eigenvalue; otherwise the iteration raises. The interval to damp comes from a short Lanczos run and from the block itself; a poor interval
costs rounds, not digits.

A task returns one sum of its partial products (dimensions x block, 16 KB for 64 dimensions); Spark adds them by entry. The driver holds n, the
sums and a few blocks, whatever the number of vectors.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; vectors of different lengths
are whitened apart, each length with its own fit list; empty vectors have no components and give no rows; equal rows are one vector of the fit list but give
rows each; null and repeated vec_ids are kept; a component without variance (a single vector, or fewer
dimensions in use) has null whitened values; entries beyond 2**52 / 64 are cut to that; a deviation beyond a long is null; columns other than
vec_id and embedding are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import drop_stored, stored

OFFSET, SCALE = 1_000_000, 64
COMPONENTS, GUARD, DEGREE, ROUNDS = 16, 16, 12, 40
TOLERANCE = 1e-13
#: What a residual may be at least relative to the largest eigenvalue, if rounds do not lower it any more.
ROUNDING = 1e-11
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and x for the rows whose vector is whole and finite."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(1 << 52)
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * SCALE))) + OFFSET)
    return vectors.where(F.col("embedding").isNotNull() & ~odd & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _entries(sums: np.ndarray) -> pa.RecordBatch:
    """A matrix as rows (i, j, value)."""
    i, j = np.divmod(np.arange(sums.size), sums.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums.ravel())], ["i", "j", "value"])


def _centring(n: int, sums: np.ndarray):
    """A function that subtracts the mean: whole numbers first, so only the last step rounds."""
    whole, rest = np.divmod(sums, n)
    return lambda x: (x - whole) - rest / n


@dataclass
class Covariance:
    """The distinct vectors of a length and what multiplies their covariance with a block."""

    rows: DataFrame
    n: int
    sums: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V @ block: one pass over the vectors."""
        n, width, centre = self.n, self.width, _centring(self.n, self.sums)
        shipped = self.rows.sparkSession.sparkContext.broadcast(block)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, total, seen = shipped.value, None, False
            for batch in batches:
                x = centre(_matrix(batch.column("x"), width))
                part = x.T @ (x @ q)
                total, seen = part if not seen else total + part, True
            if seen:
                yield _entries(total / n)

        found = self.rows.select("x").mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
        shipped.destroy()
        out = np.zeros(block.shape)
        out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("value").to_numpy()
        return out

    def trace(self) -> float:
        """Sum of the variances: one pass."""
        width, centre = self.width, _centring(self.n, self.sums)

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _entries((centre(_matrix(batch.column("x"), width)) ** 2).sum(axis=0, keepdims=True))

        return self.rows.select("x").mapInArrow(squares, "i int, j int, value double").agg(F.sum("value")).first()[0] / self.n


def covariance(rows: DataFrame, width: int) -> Covariance:
    """n and the exact sums of the distinct vectors of one length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            yield _entries(np.concatenate((x.sum(axis=0), [len(x)]))[None, :])

    found = rows.select("x").mapInArrow(sums, "i int, j int, value long").groupBy("j").agg(F.sum("value").alias("value")).collect()
    totals = {r["j"]: r["value"] for r in found}
    return Covariance(rows, totals[width], np.array([totals[j] for j in range(width)], dtype=np.int64))


def lower_end(v: Covariance, top: float, steps: int = 8, seed: int = 5) -> float:
    """About the least eigenvalue, from below: the least Ritz value of a short Lanczos run minus its residual."""
    width = v.width
    q = np.random.default_rng(seed).normal(size=(width, 1))
    basis, diagonal, beside = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, width)):
        w = v.times(basis[-1])
        diagonal.append(float((basis[-1] * w).sum()))
        known = np.hstack(basis)
        for _ in range(2):
            w = w - known @ (known.T @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * top:
            break
        basis.append(w / beside[-1])
    k = len(diagonal)
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[: k - 1], 1) + np.diag(beside[: k - 1], -1))
    return max(0.0, float(values[0] - beside[k - 1] * abs(vectors[-1, 0])))


def filtered(v: Covariance, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A polynomial of V times q that is small on [low, high] and one at top; vq is V @ q."""
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (v.times(now) - centre * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def leading(v: Covariance, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of V, falling, and their unit eigenvectors as columns, certified by their residuals."""
    width = v.width
    wanted = min(wanted, width)
    block = min(width, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))[0]
    low, best = None, np.inf
    for _ in range(ROUNDS):
        vq = v.times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(values[0], 0.0)
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() if top else 0.0
        if residual <= TOLERANCE * top or (residual <= ROUNDING * top and residual > best / 2):
            return values[:wanted], q[:, :wanted]
        best = min(best, residual)
        if low is None:
            low = lower_end(v, top)
        high = max(values[-1], low + 1e-9 * top)
        if high >= top * (1 - 1e-12):
            # The whole block has one eigenvalue so far; a plain power step cannot do harm.
            q = np.linalg.qr(vq)[0]
        else:
            q = np.linalg.qr(filtered(v, q, vq, low, high, top, degree))[0]
    raise ArithmeticError(f"the leading components are not certified: residual {best / top:.2e} of the largest eigenvalue")


def _whitened(rows: DataFrame, v: Covariance, values: np.ndarray, directions: np.ndarray, trace: float, error: float | None) -> DataFrame:
    n, width, (mean, rest) = v.n, v.width, np.divmod(v.sums, v.n)
    sound = values > 1e-12 * max(values[0], 0.0)
    scale = np.where(sound, 1 / np.sqrt(np.where(sound, values, 1)), np.nan)
    shares = values / trace if trace > 0 else np.full(len(values), np.nan)
    names = [f.split()[0] for f in OUT.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x, k = _matrix(batch.column("x"), width), len(values)
                near = x - mean
                if width * (n * (float(np.abs(near).max(initial=0)) + 1)) ** 2 < 2.0**62:
                    far = n * near - rest
                    deviation = pa.array((far * far).sum(axis=1))
                else:
                    exact = [sum((n * d - r) ** 2 for d, r in zip(row, rest.tolist(), strict=True)) for row in near.tolist()]
                    deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
                out = ((near - rest / n) @ directions) * scale
                each = pa.array(np.repeat(np.arange(batch.num_rows), k))
                columns = [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(each), n)), deviation.take(each)]
                columns += [pa.array(out.ravel(), from_pandas=True), pa.array(np.tile(shares, batch.num_rows), from_pandas=True), pa.array(np.full(len(each), np.nan if error is None else error), from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.where(F.size("x") == width).mapInArrow(project, OUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors)
    fit = stored(rows.select("x").distinct())
    out = spark.createDataFrame([], OUT)
    for width in sorted(r["width"] for r in fit.select(F.size("x").alias("width")).distinct().collect()):
        v = covariance(fit.where(F.size("x") == width), width)
        values, directions = leading(v, components)
        sound = values > 1e-12 * max(values[0], 0.0)
        error = None
        if sound.any():
            scaled = directions[:, sound] / np.sqrt(values[sound])
            error = float(np.abs(scaled.T @ v.times(scaled) - np.eye(int(sound.sum()))).max())
        out = out.unionByName(_whitened(rows, v, values, directions, v.trace(), error))
    drop_stored(fit)
    return out
