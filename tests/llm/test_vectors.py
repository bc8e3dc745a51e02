"""Pivot-permutation links against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from panelmill.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, width int, h1 long, root long, copies int"


def brute(rows):
    sound = [i for i, r in enumerate(rows) if r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {i: np.array(rows[i][1], dtype=np.float64) / np.linalg.norm(np.array(rows[i][1], dtype=np.float64)) for i in sound}
    by = defaultdict(list)
    for i in sound:
        by[(rows[i][2], len(rows[i][1]))].append(i)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for group in by.values():
        x = np.array([unit[i] for i in group])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True):
            links[group[a]] += 1
            links[group[b]] += 1
            root[max(find(group[a]), find(group[b]))] = min(find(group[a]), find(group[b]))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return sorted((r[0], links[i], min(least[find(i)])) for i, r in enumerate(rows))


def test_links_of_a_table_with_a_large_group(spark):
    """3000 near vectors around one center, 200 groups of a few around others, exact copies, and vectors that stand alone."""
    rng = np.random.default_rng(12)
    size, rows = 32, []

    def add(center, n, spread, label):
        near = center + rng.normal(0, spread / np.sqrt(size), (n, size)) * np.linalg.norm(center)
        rows.extend((len(rows) + i, v.astype(np.float32).tolist(), label) for i, v in enumerate(near))

    add(rng.normal(size=size), 3000, 0.12, 1)
    for i in range(200):
        add(rng.normal(size=size), int(rng.integers(2, 12)), 0.1, int(i % 3))
    add(rng.normal(size=size), 300, 0.0, 2)
    for _ in range(2000):
        add(rng.normal(size=size), 1, 0.0, int(rng.integers(0, 3)))
    want = brute(rows)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8)).collect())
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert there > 1_000_000
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert found >= 0.99 * there, (found, there)
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


@pytest.mark.parametrize("block", [4, 1024])
def test_awkward_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    a, near = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(0, a, 1), (1, a, 1), (2, near, 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 2.0], 1), (8, [float("nan"), 1.0, 1.0], 1), (9, [float("inf"), 1.0, 1.0], 1), (10, [1.0, 2.0], 1), (11, [-1.0, -2.0, -3.0], 1), (12, [2.0, 4.0, 6.0], 1), (13, [], 1)]
    rows += [(20 + i, [1.0, 2.0, 3.0 + i / 1000], 3) for i in range(30)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], SCHEMA)).collect())
    assert got == brute(rows)


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
