"""Pigeonhole matching against a full edit-distance table."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm import decontaminate as D

SMALL = "/root/testdata/sf0.001"


def best(pattern, text):
    """Least distance of the pattern to any part of the text, by the full table."""
    row = list(range(len(pattern) + 1))
    least = row[-1]
    for c in text:
        before, row = row, [0]
        for i, p in enumerate(pattern):
            row.append(min(before[i] + (p != c), before[i + 1] + 1, row[i] + 1))
        least = min(least, row[-1])
    return least


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_myers_equals_the_full_table(pattern, text):
    want = best(pattern, text)
    got = D.myers(D.masks_of(pattern), len(pattern), text, len(pattern))
    assert want == len(pattern) if got is None else got[0] == want


def test_each_occurrence_within_the_budget_is_found():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(24, 160)))
        k = int(len(item) * D.RATE)
        edited = list(item)
        for _ in range(rng.randint(0, k + 2)):
            at, kind = rng.randrange(len(edited)), rng.randrange(3)
            if kind == 0:
                edited[at] = "x"
            elif kind == 1:
                edited.insert(at, "y")
            else:
                del edited[at]
        text = "".join(rng.choice("abcdefgh ") for _ in range(80)) + "".join(edited) + "".join(rng.choice("abcdefgh ") for _ in range(80))
        found = D.Matcher([(1, item)]).search(text)
        assert bool(found) == (best(item, text) <= k)
        for _, begin, end, distance in found:
            assert best(item, text[begin:end]) <= distance <= k


def test_documents_against_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect() if r["distance"] == 0}
    items = [(r["item_id"], D.normal(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], k) for r in docs.collect() for k, t in items if t in D.normal(r["text"])}
    assert got == want and want
    left = D.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in left.collect()} == {d for d, _ in D.find_leaks(docs, bench).select("doc_id", "item_id").collect()}


def test_awkward_rows(spark, awkward, no_docs):
    bench = spark.createDataFrame([(1, "The QUICK brown\nfox jumps over the lazy dog"), (2, None), (3, ""), (None, "x" * 40), (4, "short"), (5, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    docs = spark.createDataFrame([(9, "so the quick  brown fox jumps over the lazy dog, twice: the quick brown fox jumps over the lazy dog")], "doc_id long, text string")
    got = sorted(tuple(r)[:2] for r in D.find_leaks(docs, bench).collect())
    assert got == [(9, 1), (9, 1), (9, 5), (9, 5)]
    assert D.find_leaks(awkward, bench).count() == 0
    assert D.without_leaks(awkward, bench).count() == awkward.count()
    assert D.find_leaks(no_docs, bench).count() == 0
    assert D.find_leaks(awkward, bench.limit(0)).count() == 0


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "GROUP_CHARS", 2000)
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert len(D.item_groups(bench)) > 2
    split = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "GROUP_CHARS", 8_000_000)
    assert split == sorted(map(tuple, D.find_leaks(docs, bench).collect()))


def test_short_items_are_whole_words_without_edits(spark):
    bench = spark.createDataFrame([(1, "forty-two"), (2, "in Paris"), (3, "42"), (4, "  ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "It is forty-two, found in paris."), (2, "forty-twos, in Parish, 421 and x42"), (3, "(42)"), (4, "fortytwo in  Paris"), (5, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in D.find_leaks(docs, bench).collect()) == [(1, 1), (1, 2), (3, 3)]
    assert [r["doc_id"] for r in D.without_leaks(docs, bench).orderBy("doc_id").collect()] == [2, 4, 5]
