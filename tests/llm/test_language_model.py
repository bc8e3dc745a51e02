"""The Pitman-Yor scores against plain counts, exact table distributions and a sampler that seats one customer at a time."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelmill.llm import language_model

LARGER = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


def base_of(rows):
    counts = Counter(t for d, text in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return n, [(d, len(t := tokens(text)), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d, text in rows]


def test_base_scores_and_held_out_perplexity(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    n, want = base_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    assert len(got) == len(want)
    for d, size, known, base in want:
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n) and r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_the_word_before_is_the_context(spark):
    rng = random.Random(11)
    follows = list(range(3000))
    rng.shuffle(follows)
    texts = [" ".join(f"a{i} b{follows[i]}" for i in rng.choices(range(3000), k=300)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [r for r in language_model.score_documents(docs).collect() if r["held_out"]]
    # Half of the words are one of 3000, the others follow from the word before.
    assert 10 ** (-sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)) < 1.6 * 3000**0.5


def test_log_gamma():
    x = np.array([0.01, 0.3, 1.0, 2.5, 7.0, 40.0, 1e6, 1e9])
    assert language_model.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-9)


def test_packed_numbers_come_back():
    for values in ([], [0], [255, 256, 1], [2**40, 3]):
        assert language_model.unpacked(language_model.packed(np.array(values, dtype=np.int64))).tolist() == values


@pytest.mark.parametrize(("customers", "other", "discount", "chance"), [(2, 5.0, 0.7, 0.1), (7, 9.0, 0.5, 0.02), (40, 30.0, 0.8, 0.3), (300, 6.0, 0.3, 0.05)])
def test_tables_follow_their_exact_distribution(customers, other, discount, chance):
    """P(t) is proportional to S(c, t) * product of (other + discount * i) * chance, with generalised Stirling numbers S; here i counts from the dish's own tables."""
    ways = np.array([1.0])
    for n in range(1, customers):
        grown = np.zeros(len(ways) + 1)
        grown[: len(ways)] += ways * (n - discount * np.arange(1, len(ways) + 1))
        grown[1:] += ways
        ways = grown / grown.max()
    t = np.arange(1, len(ways) + 1)
    with np.errstate(divide="ignore"):
        logs = np.log(ways) + np.cumsum(np.log((other + discount * (t - 1)) * chance))
    want = np.exp(logs - logs.max())
    want /= want.sum()
    n, rng = 20_000, np.random.default_rng(1)
    # The others are frozen.
    c, o, p = np.full(n, customers), np.full(n, other), np.full(n, chance)
    tables, times = np.ones(n, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for step in range(12):
        tables, times = language_model.reseat(c, tables, times, o, discount, p, rng, step == 0)
    assert len(times) == (tables - 1).sum() and (times <= customers).all() and (times > 1).all()
    got = np.bincount(tables, minlength=customers + 1)[1:] / n
    assert np.abs(got - want).max() < 0.015, (got[:6], want[:6])


class PlainSampler:
    """Contexts over single words, one customer moved at a time."""

    def __init__(self, texts, discount, root, strength=language_model.STRENGTH):
        self.d, self.r, self.s = discount, root, strength
        self.tables, self.up = defaultdict(list), defaultdict(list)
        self.customers, self.up_customers = [], 0
        for text in texts:
            before = "\0end"
            for t in tokens(text):
                self.customers.append((before, t))
                before = t
        self.types = len({t for _, t in self.customers})
        self.of, self.tables_of, self.up_tables = Counter(), Counter(), 0
        for c in self.customers:
            self.add(*c)

    def base(self):
        return (1 - language_model.UNKNOWN) / self.types

    def parent(self, w):
        sizes = self.up[w]
        return (sum(sizes) - self.r * len(sizes) + (self.s + self.r * self.up_tables) * self.base()) / (self.s + self.up_customers)

    def chance(self, u, w):
        sizes = self.tables[u, w]
        return (sum(sizes) - self.d * len(sizes) + (self.s + self.d * self.tables_of[u]) * self.parent(w)) / (self.s + self.of[u])

    def sit(self, sizes, discount, new):
        x = random.random() * (sum(sizes) - discount * len(sizes) + new)
        for i, n in enumerate(sizes):
            x -= n - discount
            if x < 0:
                sizes[i] += 1
                return False
        sizes.append(1)
        return True

    def leave(self, sizes):
        i = random.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    def add(self, u, w):
        if self.sit(self.tables[u, w], self.d, (self.s + self.d * self.tables_of[u]) * self.parent(w)):
            self.tables_of[u] += 1
            self.up_tables += self.sit(self.up[w], self.r, (self.s + self.r * self.up_tables) * self.base())
            self.up_customers += 1
        self.of[u] += 1

    def remove(self, u, w):
        if self.leave(self.tables[u, w]):
            self.tables_of[u] -= 1
            self.up_tables -= self.leave(self.up[w])
            self.up_customers -= 1
        self.of[u] -= 1

    def sweep(self):
        for c in self.customers:
            self.remove(*c)
            self.add(*c)


def test_scores_equal_those_of_a_plain_sampler(spark):
    rng = random.Random(8)
    random.seed(8)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(60):
        text, at = [], 0
        for _ in range(40):
            at = (at * 3 + rng.choice([0, 0, 0, 1, rng.randrange(30)])) % 30
            text.append(words[at])
        texts.append(" ".join(text))
    docs = list(enumerate(texts))
    got = {r["doc_id"]: r for r in language_model.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    learned = [t for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    pairs = Counter(p for t in learned for p in zip(["\0end", *tokens(t)], tokens(t), strict=False))
    behind = Counter(w for _, w in pairs)
    plain = PlainSampler(learned, *(language_model._discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())) for c in (pairs, behind)))
    total = Counter()
    for sweep in range(30):
        plain.sweep()
        if sweep >= 10:
            for p in {p for _, t in docs for p in zip(["\0end", *tokens(t)], tokens(t), strict=False)}:
                total[p] += plain.chance(*p) / 20
    for d, t in docs:
        want = sum(math.log10(total[p]) for p in zip(["\0end", *tokens(t)], tokens(t), strict=False))
        assert got[d]["score"] == pytest.approx(want, rel=0.02)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    counts = rng.choice([1, 1, 2, 5, 400], 60)
    s = language_model.Settings(int(counts.sum()), 60, 0.7, 0.6)
    tables, times = np.ones(60, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for _ in range(3):
        total = int(counts.sum()), int(tables.sum())
        p = s.parent(counts, tables, total)
        assert (p > 0).all() and p.sum() + s.escape(total) * s.unknown == pytest.approx(1.0)
        tables, times = language_model.reseat(counts, tables, times, language_model.STRENGTH + s.root * (total[1] - tables), s.root, np.full(60, s.known), rng)
        assert (tables >= 1).all() and (tables <= counts).all()


def test_scores_of_awkward_rows(spark, awkward, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    n, want = base_of(rows)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in language_model.score_documents(awkward).collect())
    assert got == sorted((d or 0, size, known, round(base, 6)) for d, size, known, base in want)
    assert language_model.score_documents(no_docs).count() == 0
    only_held = awkward.where("doc_id = 3")  # crc32('3') % 5 == 1 does not hold for every key; both cases have a result
    assert language_model.score_documents(only_held).count() == 1


def test_counts_beyond_32_bits():
    import pyarrow as pa

    n = 2**33 + 7
    rows = [{"chunk": c, "bucket": 0, "words": np.array([5], dtype="<u8").tobytes(), "counts": language_model.packed(np.array([n // 2 + c]))} for c in (0, 1)]
    out = language_model._name(4)((pa.scalar(0),), pa.Table.from_pylist(rows)).to_pylist()
    assert [language_model.unpacked(r["counts"]).tolist() for r in out] == [[n // 2 * 2 + 1]] * 3 and out[-1]["tokens"] == n // 2 * 2 + 1


@pytest.mark.parametrize("hot", [1, 1 << 20])
def test_pairs_are_counted_whatever_the_buckets(hot, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_model, "HOT", hot)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 20, rng.integers(0, 50)) for _ in range(30)]
    chunk = language_model._Chunk(0)
    chunk.add(np.concatenate(texts).astype(np.uint64), np.array([len(t) for t in texts]), doc_ids=np.arange(30), missing=np.zeros(30), held=np.zeros(30), learn=np.arange(30) % 3 > 0)
    parts = list(chunk.parts(7))
    named = [r for p in parts if p["bucket"] >= 0 for r in language_model._name(7)((pa.scalar(p["bucket"]),), pa.Table.from_pylist([p])).to_pylist() if r["chunk"] == 0]
    lists = list(language_model._Pairs(pa.Table.from_pylist([parts[-1] | {"ids": None, "counts": None}, *named]), 7).lists())
    number = {int(w): int(i) - 1 for p, r in zip((p for p in parts if p["bucket"] >= 0), named, strict=True) for w, i in zip(np.frombuffer(p["words"], dtype="<u8"), language_model.unpacked(r["ids"]), strict=True)}
    end = int(language_model.END)
    want = Counter(p for i, t in enumerate(texts) if i % 3 for p in zip([end, *t.tolist()], [*t.tolist(), end], strict=True))
    got = Counter()
    for r in lists:
        for u, w, n in zip(*language_model.unpack_pairs(r), language_model.unpacked(r["counts"]), strict=True):
            got[int(u), int(w)] += int(n)
    assert +got == Counter({(number[u], number[w]): n for (u, w), n in want.items()})
