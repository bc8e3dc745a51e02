"""Order MinHash classes and the alignment against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm import neardup
from panelmill.llm.components import connected

SMALL = "/root/testdata/sf0.01"


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = row[:]
        for j, b in enumerate(y):
            row[j + 1] = before[j] + 1 if a == b else max(before[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=40))
def test_wide_band_gives_the_longest_common_subsequence(x, y):
    assert neardup.banded_lcs(np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64), 80) == lcs(x, y)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.data())
def test_similarity_against_the_full_table(x, data):
    y = list(x)
    for _ in range(data.draw(st.integers(0, 12))):
        at = data.draw(st.integers(0, len(y)))
        y[at : at + data.draw(st.integers(0, 1))] = data.draw(st.lists(st.integers(0, 30), max_size=2))
    if y:
        both = lcs(x, y)
        assert neardup.similar(np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64)) == (both / (len(x) + len(y) - both) >= 0.8 - 1e-12)


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def brute(rows):
    """Class by row number: all pairs are aligned."""
    facts = neardup.sketched(pd.Series([t for _, t in rows]))
    words = [neardup._words(w) for w in facts["words"]]
    nodes = {k: i for i, k in reversed(list(enumerate(facts["key"])))}
    links = [(a, b) for a, b in itertools.combinations(sorted(nodes.values()), 2) if len(words[a]) and len(words[b]) and neardup.similar(words[a], words[b])]
    found = components(links + [(nodes[k], i) for i, k in enumerate(facts["key"]) if nodes[k] != i])
    return [found.get(i, i) for i in range(len(rows))]


def test_classes_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want = {rows[i][0]: rows[c][0] for i, c in enumerate(brute(rows))}
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    # Sketches are drawn, so a pair near the edge may stay apart; none is joined that brute force leaves apart.
    assert all(want[r["class_id"]] == want[d] for d, r in got.items())
    assert sum(r["class_id"] == want[d] for d, r in got.items()) >= 0.998 * len(want)
    assert all(r["kept"] == (d == r["class_id"]) for d, r in got.items())


@pytest.mark.parametrize("length", [12, 30, 100, 200, 400])
def test_planted_edits_are_caught(spark, length):
    """Copies with 1 to 9 % of the words changed, and as many inserted or left out as keep the similarity at 0.8."""
    rng = random.Random(length)
    rows, n = [], 0
    for _ in range(150):
        words = [f"w{rng.randrange(20_000)}" for _ in range(length)]
        own = list(words)
        for at in rng.sample(range(length), max(1, int(length * rng.uniform(0.01, 0.09)))):
            kind = rng.randrange(3)
            own[at] = f"x{rng.randrange(10**6)}" if kind else own[at] + f" y{rng.randrange(10**6)}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(own))]
        n += 1
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (d, d - d % 2) for d, c in got.items())
    assert sum(c == d - 1 for d, c in got.items() if d % 2) >= 0.95 * n


def test_a_large_group_of_near_copies_around_one_text(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        own = list(base)
        for at in rng.sample(range(300), 3):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(120))) for i in range(50)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {d: 0 if d < 1000 else d for d, _ in rows}


def test_short_texts_of_different_length(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for length in [8] * 30 + [9] * 60 + [12] * 60 + [20] * 60 + [24] * 60:
        words = [f"w{rng.randrange(10**9)}" for _ in range(length)]
        more = [f"x{rng.randrange(10**9)}" for _ in range(max(1, (length - 4) // 4))]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words + more))]
        n += 1
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.data())
def test_short_texts_share_a_key_wherever_they_are_similar(x, data):
    y = list(x)
    for _ in range(data.draw(st.integers(1, 6))):
        at = data.draw(st.integers(0, len(y)))
        y[at : at + data.draw(st.integers(0, 1))] = data.draw(st.lists(st.integers(0, 60), max_size=2))
    both = [np.array(t, dtype=np.uint64) for t in (x, y)]
    if y and x != y and min(len(x), len(y)) <= neardup.SHORT and neardup.similar(*both):
        a, b = (set(neardup.bucket_keys(t, neardup._kmers(t.astype("<u4").tobytes())).tolist()) for t in both)
        assert a & b


def test_one_edit_anywhere_in_a_short_text(spark):
    rng, rows = random.Random(8), []
    for length in range(4, 25):
        for at in range(length):
            words = [f"w{rng.randrange(10**9)}" for _ in range(length)]
            edits = [words[:at] + ["new"] + words[at:]] + ([words[:at] + ["new"] + words[at + 1 :]] if length >= 9 else [])
            rows += [(len(rows), len(rows), " ".join(words))]
            rows += [(len(rows) + i, len(rows) - 1, " ".join(own)) for i, own in enumerate(edits)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")).collect()}
    assert got == {d: c for d, c, _ in rows}


def test_awkward_rows(spark, awkward, no_docs):
    got = neardup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count() and sum(r["kept"] for r in got) == len({(r["class_id"], r["class_size"]) for r in got if r["doc_id"] is not None or r["class_size"] == 1})
    by = {r["doc_id"]: r for r in got}
    assert by[1]["class_id"] == -8 and by[2]["class_id"] == 2 and by[3]["class_id"] == 2
    assert neardup.near_duplicates(no_docs).count() == 0
    clashing = awkward.selectExpr("doc_id", "text", "lang AS root", "source AS __key", "n_chars AS key", "shard AS origin", "tie AS omh", "score AS `a.b`", "n_chars AS node", "n_chars AS row")
    kept = neardup.deduplicate(clashing)
    assert kept.columns == clashing.columns and kept.count() == len({r["text"] or "" for r in awkward.collect()})
    kept = neardup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    texts = [r["text"] for r in kept.collect()]
    assert sorted(t or "" for t in texts) == sorted({r["text"] or "" for r in awkward.collect()})


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in components([p for p in pairs if p[0] != p[1]]).items()}
