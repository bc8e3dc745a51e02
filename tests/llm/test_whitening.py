"""Whitening against a dense eigendecomposition, and on awkward rows."""

import numpy as np
import pytest

from panelmill.llm import registry, whitening

ROWS = "vec_id long, embedding array<float>"


def dense(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


def check(out, ids, vectors):
    x, n, sums, values, directions = dense(vectors)
    k = min(16, x.shape[1])
    white = ((n * x - sums) / n) @ directions[:, :k] / np.sqrt(values[:k])
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-7
    signs = np.sign(got * white)
    assert all(len(set(signs[np.abs(white[:, j]) > 1e-6, j])) == 1 for j in range(k))
    assert out.groupby("component").explained.first().to_numpy() == pytest.approx(values[:k] / values.sum(), rel=1e-9)
    deviation = out[out.component == 1].set_index("vec_id").deviation.loc[ids]
    assert deviation.tolist() == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert set(out.n) == {n} and out.identity_error.max() < 1e-9


def test_whole_table_equals_a_dense_decomposition(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    check(registry.op12_whitening(spark, "/root/testdata/sf0.01").toPandas(), table.vec_id.tolist(), table.embedding.tolist())


def test_copies_count_once_and_gaps_are_certified(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 40)) * np.geomspace(100, 0.5, 40)).astype(np.float32)
    vectors = np.concatenate((vectors, np.repeat(vectors[:1], 400, axis=0)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], ROWS)
    check(whitening.whiten(df).toPandas(), list(range(len(vectors))), vectors)


def test_passes_multiply_the_covariance(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(999_000, 1_001_000, size=(200, 7))
    v = whitening.covariance(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>"), 7)
    centred = x - x.mean(axis=0)
    block = rng.normal(size=(7, 3))
    assert v.n == 200 and v.sums.tolist() == x.sum(axis=0).tolist()
    assert v.times(block) == pytest.approx(centred.T @ centred @ block / 200, rel=1e-12)
    assert v.trace() == pytest.approx((centred**2).sum() / 200, rel=1e-13)
    low = whitening.lower_end(v, 1e6, steps=7)
    assert 0 <= low <= np.linalg.eigvalsh(centred.T @ centred / 200)[0] * (1 + 1e-9)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, -1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, []), (None, [0.0, 0.5]), (9, [5.0]), (3, [2.5, 2.5]), (10, [-1e30, 1e30, 1.0])]
    df = spark.createDataFrame([(i, v, "clash", 4.0) for i, v in rows], ROWS + ", x string, whitened double")
    out = whitening.whiten(df).toPandas()
    two = out[out.n == 4]
    assert sorted(two.groupby("component").size().tolist()) == [6 - 1, 6 - 1] and two.vec_id.isna().sum() == 2
    copies = two[two.vec_id.isin([1, 2])].pivot(index="vec_id", columns="component", values="whitened")
    assert (copies.loc[1] == copies.loc[2]).all()
    alone = out[out.n == 1]
    assert sorted(alone.vec_id) == [9, 10, 10, 10] and alone.whitened.isna().all() and alone.explained.isna().all() and (alone.deviation == 0).all()
    assert whitening.whiten(df.limit(0)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], ROWS)).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all() and flat.identity_error.max() < 1e-9
