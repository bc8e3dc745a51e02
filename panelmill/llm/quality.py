"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_BYTES bytes. Every passage of every document is encoded
as a vector (shares of byte classes, repetition, hashed byte trigrams), mapped to a hidden state, and
weighted by gated attention; a logistic layer scores the weighted sum. Only document labels are
needed: the attention weights are learned from them, which is what multiple-instance learning means.

Fitting takes a bounded sample of labelled rows (max_rows documents, the first by a seeded hash of the key, however
often a key occurs) and of each at most most_passages (FIT_PASSAGES) passages at even distances, so at most
max_rows * most_passages * WIDTH * 2 bytes come to the driver (156 MB). Encoding runs on Spark, the small
gradient descent on the sample's vectors runs on the driver.
Scoring covers every document and every passage.

Defined results: a null text is empty and an empty text is one empty passage, so it has a score;
rows with a null key are never used for fitting, and their held_out is null; a document that occurs twice among the labels is
used as often; without any labelled row every score is the prior 0.5. Labels, language, source
and key are no inputs of a score. Other columns pass through or are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelmill.llm.common import partitions, text_or_empty

PASSAGE_BYTES = 384
TRIGRAM_BINS = 64
FIT_PASSAGES = 256
THRESHOLD = 0.3
_CLASSES = 8
WIDTH = _CLASSES + 4 + TRIGRAM_BINS


def _byte_classes() -> np.ndarray:
    """lower, upper, digit, space, newline, sentence mark, other ASCII, beyond ASCII."""
    kind = np.full(256, 7, dtype=np.int64)
    for b in range(128):
        c = chr(b)
        kind[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t" else 4 if c in "\r\n" else 5 if c in ".,;:'-" else 6
    return kind


_KIND = _byte_classes()


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of the texts, and the number of passages of each text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    total, data = int(counts.sum()), np.frombuffer(b"".join(texts), dtype=np.uint8)
    first = np.cumsum(counts) - counts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(begin, lengths)
    passage = np.repeat(first, lengths) + place // PASSAGE_BYTES
    size = np.maximum(1, np.bincount(passage, minlength=total)).astype(np.float64)
    out = np.zeros((total, WIDTH), dtype=np.float32)
    kind = _KIND[data]
    shares = np.bincount(passage * _CLASSES + kind, minlength=total * _CLASSES).reshape(total, _CLASSES) / size[:, None]
    out[:, :_CLASSES] = np.sqrt(shares)
    # Words: where a run of no space begins; their mean length, and the share that an earlier one in the text repeats.
    inside = (kind != 3) & (kind != 4)
    begins = inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        opening = begin[lengths > 0]
        begins[opening] = inside[opening]
    starts = np.flatnonzero(begins)
    word_of = passage[starts]
    words = np.bincount(word_of, minlength=total)
    out[:, _CLASSES] = np.log1p(size / np.maximum(1, words)) / 4
    # The share of words that an earlier one repeats; without any word it is 1.
    out[:, _CLASSES + 1] = 1
    if len(starts):
        text_of = np.repeat(np.arange(len(texts)), lengths)[starts]
        gram = np.zeros(len(starts), dtype=np.uint64)
        ends = np.minimum(np.append(starts[1:], len(data)), (begin + lengths)[text_of])
        for i in range(12):
            at = starts + i
            gram = gram * np.uint64(0x100000001B3) + np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
        keyed = (gram + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        _, once = np.unique(keyed, return_index=True)
        fresh = np.zeros(len(starts), dtype=np.float64)
        fresh[once] = 1
        out[:, _CLASSES + 1] = 1 - np.bincount(word_of, weights=fresh, minlength=total) / np.maximum(1, words)
        marked = (kind[np.maximum(starts - 2, 0)] >= 5) & (place[starts] >= 2)
        out[:, _CLASSES + 2] = np.bincount(word_of, weights=marked, minlength=total) / np.maximum(1, words)
    out[:, _CLASSES + 3] = np.log1p(np.repeat(lengths, counts)) / 12
    if len(data) > 2:
        # Letters fold to lower case; the three bytes of a gram must lie in one passage.
        low = np.where(kind == 1, data + 32, data).astype(np.int64)
        hashed = ((low[:-2] * 31 + low[1:-1]) * 31 + low[2:]) * 2654435761 >> 12
        same = passage[:-2] == passage[2:]
        bins = passage[:-2][same] * TRIGRAM_BINS + (hashed[same] & (TRIGRAM_BINS - 1))
        out[:, -TRIGRAM_BINS:] = np.sqrt(np.bincount(bins, minlength=total * TRIGRAM_BINS).reshape(total, TRIGRAM_BINS) / size[:, None])
    return out, counts


@dataclass
class Model:
    """Encoder (w, b), gated attention (v, u, a) and the logistic layer (c, d), with the feature scaling."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def hidden(self, x: np.ndarray, times=np.matmul) -> np.ndarray:
        return np.tanh(times((x - self.mean) * self.scale, self.w) + self.b)

    def attend(self, h: np.ndarray, first: np.ndarray, counts: np.ndarray, times=np.matmul) -> tuple[np.ndarray, ...]:
        """Attention weights by passage and the bag vectors."""
        t, g = np.tanh(times(h, self.v)), 1 / (1 + np.exp(-times(h, self.u)))
        e = times(t * g, self.a)
        top = np.maximum.reduceat(e, first)
        p = np.exp(e - np.repeat(top, counts))
        p /= np.repeat(np.add.reduceat(p, first), counts)
        return t, g, p, np.add.reduceat(p[:, None] * h, first, axis=0)

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The score of each bag, to the last digit a function of that bag alone."""
        _, _, _, z = self.attend(self.hidden(x, row_by_row), np.cumsum(counts) - counts, counts, row_by_row)
        return 1 / (1 + np.exp(-(row_by_row(z, self.c) + self.d[0])))


def row_by_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b with one order of sums for every row, whatever the number of rows (a library's product rounds by the shape)."""
    out = np.zeros((len(a), *b.shape[1:]))
    for j in range(a.shape[1]):
        out += a[:, j : j + 1] * b[j] if b.ndim > 1 else a[:, j] * b[j]
    return out


PARAMETERS = ("w", "b", "v", "u", "a", "c", "d")


def _gradients(m: Model, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Mean gradient of the log loss over the bags."""
    first = np.cumsum(counts) - counts
    s = (x - m.mean) * m.scale
    h = np.tanh(s @ m.w + m.b)
    t, g, p, z = m.attend(h, first, counts)
    out = 1 / (1 + np.exp(-(z @ m.c + m.d[0])))
    delta = (out - y) / len(y)
    dz = np.repeat(delta[:, None] * m.c, counts, axis=0)
    inner = (dz * h).sum(axis=1)
    de = p * (inner - np.repeat(np.add.reduceat(p * inner, first), counts))
    dt, dg = de[:, None] * m.a * g * (1 - t * t), de[:, None] * m.a * t * g * (1 - g)
    dh = p[:, None] * dz + dt @ m.v.T + dg @ m.u.T
    ds = dh * (1 - h * h)
    return {"w": s.T @ ds, "b": ds.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ delta, "d": np.array([delta.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on mini-batches of bags; the order of bags and all starting weights come from the seed."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags).astype(np.float64)
    mean, spread = every.mean(0), every.std(0)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    m = Model(mean, 1 / np.maximum(spread, 1e-3), normal(WIDTH, hidden), np.zeros(hidden), normal(hidden, gate), normal(hidden, gate), normal(gate), normal(hidden), np.array([np.log(prior / (1 - prior))]))
    moment = {k: (np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))) for k in PARAMETERS}
    step = 0
    for turn in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x, counts = np.concatenate([bags[i] for i in part]).astype(np.float64), np.array([len(bags[i]) for i in part])
            step += 1
            now = rate * (1 - turn / rounds)
            for k, grad in _gradients(m, x, counts, labels[part]).items():
                grad = grad + 1e-4 * getattr(m, k)
                first, second = moment[k]
                first *= 0.9
                first += 0.1 * grad
                second *= 0.999
                second += 0.001 * grad * grad
                getattr(m, k)[...] -= now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return m


def _encode_bags(most_passages: int):
    def encode(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 64):
                x, counts = encode_passages(texts[at : at + 64])
                edges = np.concatenate(([0], np.cumsum(counts)))
                bags = [x[a + np.unique(np.linspace(0, b - a - 1, min(b - a, most_passages)).astype(np.int64))] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                packed = pa.array([bag.astype(np.float16).tobytes() for bag in bags], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(bags)) for k in ("doc_id", "label")), packed], ["doc_id", "label", "bag"])

    return encode


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, max_rows: int = 4000, seed: int = 7, most_passages: int = FIT_PASSAGES) -> Model | None:
    """Fit on at most max_rows labelled documents, the first by a seeded hash of doc_id.

    allowed: a condition on doc_id that rows for fitting must meet. most_passages: of a document with more passages, only so many at
    even distances are learned from (scores read all); a large number lifts the bound, and the driver's memory with it.
    """
    rows = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label").limit(max_rows)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # The chosen keys are bounded by max_rows, so they are broadcast and the texts stay where they are.
    pairs = texts.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    bags = pairs.repartition(partitions(docs.sparkSession)).mapInArrow(_encode_bags(most_passages), "doc_id long, label double, bag binary")
    # A key may stand for many rows, so the bound is set once more where the bags are made.
    found = bags.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label", "bag").limit(max_rows).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["label"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], dtype=np.float16).reshape(-1, WIDTH).astype(np.float32) for r in found]
    return fit(bags, np.array([r["label"] for r in found]), seed=seed)


def score(model: Model | None, text: str | Column = "text") -> Column:
    """The score of a text column, 0 to 1; higher: label 1 is likelier."""
    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), 0.5)
        if model is not None:
            raw = [b"" if t is None else t.encode() for t in texts]
            at = 0
            while at < len(raw):
                to, size = at, 0
                while to < len(raw) and (to == at or size + len(raw[to]) <= 1 << 18):
                    size += len(raw[to])
                    to += 1
                out[at:to] = model.scores(*encode_passages(raw[at:to]))
                at = to
        return pd.Series(out, index=texts.index)

    return scored(F.col(text) if isinstance(text, str) else text)
