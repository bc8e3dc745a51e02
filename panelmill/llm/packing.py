"""Packing along a space-filling curve.

Each document is a hashed bag of words. A fixed random projection maps it to three dimensions, whose
Hilbert key orders the documents so that similar ones are neighbours. The documents, as token ids,
are sorted by ranges of that key and laid end to end along the curve into sequences; a document that
crosses the edge of a sequence is cut there.

Each range of the curve packs by itself. What is left at its end is cut into sequences of
power-of-two lengths, which need no padding.

Defined results: a null or empty text holds only the end id; equal texts have equal keys and are
ordered by doc_id, then by place in the input; repeated rows are packed each by itself; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import partitions, stored, text_or_empty
from panelmill.llm.tokens import encoder
from panelmill.llm.words import hashed_words, string_parts

DIMENSIONS, BITS, BINS = 3, 16, 512
ENCODED = "doc_id long, origin long, curve_key long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Tokens of one range of the curve: as few as the first number while Spark's shuffle partitions cover all ranges, up to the second beyond.
LEAST_TOKENS, RANGE_TOKENS = 4 << 20, 64 << 20


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on a Hilbert curve of integer points (n x d), coordinates below 2**bits.

    The coordinates are turned into the transposed Hilbert form by exchanging and inverting low bits
    from the highest bit down, Gray-coded, and their bits are interleaved.
    """
    x = points.T.astype(np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        low = bit - 1
        for i in range(d):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        flip ^= np.where((x[d - 1] & bit) != 0, bit - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def projection(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BINS, DIMENSIONS))


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert keys of a column of texts."""
    offsets, data = string_parts(texts)
    out, axes = np.zeros(len(texts), dtype=np.int64), projection()
    for a, b, counts, words in hashed_words(offsets, data, white_space_only=False):
        row = np.repeat(np.arange(b - a), counts)
        bag = np.bincount(row * BINS + (words % np.uint64(BINS)).astype(np.int64), minlength=(b - a) * BINS).reshape(b - a, BINS)
        vector = np.sqrt(bag)
        vector = vector / np.maximum(1e-9, np.linalg.norm(vector, axis=1, keepdims=True))
        flat = 1 / (1 + np.exp(-1.7 * (vector @ axes)))  # near-uniform in each dimension
        out[a:b] = hilbert_key(np.minimum((flat * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
    return out


def _encode(vocabulary: str, keeps_space: bool, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary, keeps_space)
        end, width = np.array([end_id], dtype=codec.dtype).tobytes(), codec.dtype.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [x + end for x in codec.encode(some.column("text").to_pylist())]
                size = pa.array([len(x) // width for x in ids], pa.int64())
                columns = [some.column("doc_id"), some.column("origin"), pa.array(curve_keys(some.column("text"))), size, pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "origin", "curve_key", "n_tokens", "ids"])

    return encode


def _pack(length: int, width: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        sequence, fill, waiting, ready = 0, 0, [], []

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            ids = [np.frombuffer(p[3], dtype=f"<u{width}").astype("<u4").tobytes() for p in pieces]
            kinds = dict(zip(("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"), range(7), strict=True))
            columns = [pa.array(ids, pa.binary()) if k == "ids" else pa.array([p[i] for p in pieces], pa.int64()) for k, i in kinds.items()]
            return pa.RecordBatch.from_arrays(columns, list(kinds))

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                total, at = len(ids) // width, 0
                while at < total:
                    n = min(total - at, length - fill)
                    waiting.append((doc, at, n, ids[at * width : (at + n) * width], total, first + sequence, fill))
                    at, fill = at + n, fill + n
                    if fill == length:
                        ready += waiting
                        waiting, fill, sequence = [], 0, sequence + 1
                if len(ready) >= 2000:
                    yield rows(ready)
                    ready = []
        # The rest: sequences of falling powers of two, cut anew where they end.
        left, place = fill, 0
        for doc, start, n, ids, total, _, _ in waiting:
            at = 0
            while at < n:
                room = (1 << (left.bit_length() - 1)) - place
                take = min(n - at, room)
                ready.append((doc, start + at, take, ids[at * width : (at + take) * width], total, first + sequence, place))
                at, place = at + take, place + take
                if take == room:
                    left, place, sequence = left - place, 0, sequence + 1
        if ready:
            yield rows(ready)

    return pack


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 2048, keeps_space: bool = False, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    Texts are encoded once, in place; the ids and keys are written to the shared folder, so neither the
    sampling of the range bounds nor a lost executor makes Spark encode again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("origin"), text_or_empty().alias("text"))
    encoded = stored(rows.mapInArrow(_encode(vocabulary, keeps_space, end_id), ENCODED))
    tokens = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(1, min(partitions(docs.sparkSession), -(-tokens // LEAST_TOKENS)), -(-tokens // RANGE_TOKENS))
    along = encoded.repartitionByRange(ranges, "curve_key", "doc_id", "origin").sortWithinPartitions("curve_key", "doc_id", "origin")
    width = 2 if _small(vocabulary) else 4
    return along.select("doc_id", "ids").mapInArrow(_pack(length, width), PIECES)


def _small(vocabulary: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16
