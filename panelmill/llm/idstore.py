"""Token-id shard files with a minimal perfect hash index.

A shard holds the ids of consecutive documents in ascending key order, a key log, and an index: a
minimal perfect hash (levels of bit arrays; a key is settled on the first level where no other key
shares its bit, and its slot is the rank of that bit) leads from a key to a slot with a stored
fingerprint, the first row and the number of rows of that key. A lookup reads a bounded number of
bits, one fingerprint and two offsets, whatever the shard's size. The manifest has the first and last key of
each shard; Store finds a key's shard there by binary search.

Files are written under a temporary name and renamed, so a repeated task attempt replaces its file
with the same bytes. Layout, little-endian: MAGIC, HEADER as int64, then the sections in their order.

Defined results: a null text is empty and holds only the end id; rows with a null key come first,
are stored and read back in order, and can't be looked up; rows that share a key follow one another
(ordered by text) and one lookup finds all of that shard; an empty table writes no shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import file_system, partitions, shared_dir, sized_partitions, stored, text_or_empty
from panelmill.llm.tokens import encoder
from panelmill.llm.words import U64, mix

MAGIC = b"PMIDS001"
#: rows, rows with a null key, keys, ids, bytes per id, levels, bits of all levels, keys beyond the levels
HEADER = 8
GAMMA, MOST_LEVELS = 2.0, 40
#: Ids that a task holds before it closes a shard.
SHARD_IDS = 16 << 20
MANIFEST = "part int, seq int, file string, rows long, ids long, first_key long, last_key long"
#: Bytes of input for one task, and shards that a store keeps open.
TASK_BYTES, OPEN_SHARDS = 128 << 20, 64
READ = "doc_id long, start long, n_tokens long, ids binary"


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))


@dataclass
class PerfectHash:
    """Slots 0..n-1 for n distinct keys. Level i owns bits[start[i]:start[i+1]]; rest: sorted keys beyond the levels."""

    start: np.ndarray
    words: np.ndarray
    rank: np.ndarray
    rest: np.ndarray

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        left, bits, start = keys.astype(np.int64), [], [0]
        for level in range(MOST_LEVELS):
            if not len(left):
                break
            size = -(-int(GAMMA * len(left)) // 64) * 64
            place = (_spread(left, level) % U64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            bits.append(alone)
            start.append(start[-1] + size)
            left = left[~alone[place]]
        flat = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
        return PerfectHash._of(np.array(start, dtype=np.int64), np.packbits(flat, bitorder="little").view("<u8"), np.sort(left))

    @staticmethod
    def _of(start: np.ndarray, words: np.ndarray, rest: np.ndarray) -> PerfectHash:
        counts = np.bitwise_count(words).astype(np.int64)
        return PerfectHash(start, words, np.cumsum(counts) - counts, rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, -1 where no level has it. A key outside the set may get any slot."""
        keys = keys.astype(np.int64)
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level in range(len(self.start) - 1):
            if not len(open_):
                break
            size = int(self.start[level + 1] - self.start[level])
            bit = self.start[level] + (_spread(keys[open_], level) % U64(size)).astype(np.int64)
            word, within = self.words[bit >> 6], (bit & 63).astype(U64)
            hit = (word >> within) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << within) - U64(1))).astype(np.int64)
            out[open_[hit]] = (self.rank[bit >> 6] + below)[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            settled = int(np.bitwise_count(self.words).sum())
            out[open_] = np.where(self.rest[at] == keys[open_], settled + at, -1)
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_spread(keys, 1 << 20) >> U64(32)).astype("<u4")


def pack_shard(keys: list[int | None], documents: list[bytes], width: int) -> list[bytes]:
    """The file of one shard, as parts. keys ascend, null ones first; documents: packed ids of each row."""
    nulls = sum(k is None for k in keys)
    row_keys = np.array([0 if k is None else k for k in keys], dtype="<i8")
    offsets = np.zeros(len(keys) + 1, dtype="<i8")
    np.cumsum([len(d) // width for d in documents], out=offsets[1:])
    distinct, first, count = np.unique(row_keys[nulls:], return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    mark, row, many = np.zeros(len(distinct), dtype="<u4"), np.zeros(len(distinct), dtype="<i8"), np.zeros(len(distinct), dtype="<i8")
    mark[slot], row[slot], many[slot] = fingerprint(distinct), first + nulls, count
    header = np.array([len(keys), nulls, len(distinct), offsets[-1], width, len(index.start) - 1, len(index.words) * 64, len(index.rest)], dtype="<i8")
    sections = [header, index.start.astype("<i8"), index.words, index.rest.astype("<i8"), row, many, offsets, row_keys, mark]
    return [MAGIC, *(s.tobytes() for s in sections), *documents]


class Shard:
    """Keyed and ordered access to one shard file; ids are read by range, never the whole payload."""

    def __init__(self, file: str):
        system, path = file_system(file)
        self.source = system.open_input_file(path)
        if self.source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{file} is no id shard")
        at = len(MAGIC)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * n
            out = np.frombuffer(self.source.read_at(size, at), dtype=kind)
            at += size
            return out

        self.rows, self.nulls, keys, self.ids, self.width, levels, bits, rest = take("<i8", HEADER).tolist()
        start, words, left = take("<i8", levels + 1), take("<u8", bits // 64), take("<i8", rest)
        self.index = PerfectHash._of(start, words, left)
        self.first_row, self.row_count = take("<i8", keys), take("<i8", keys)
        self.offsets, self.keys, self.marks = take("<i8", self.rows + 1), take("<i8", self.rows), take("<u4", keys)
        self.payload = at

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows for each key; no rows where the fingerprint differs."""
        slot = self.index.slots(keys)
        if not len(self.marks):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        found = (slot >= 0) & (self.marks[slot] == fingerprint(keys))
        return np.where(found, self.first_row[slot], 0), np.where(found, self.row_count[slot], 0)

    def read(self, first: int, last: int) -> bytes:
        """The packed ids of rows first to last, last exclusive."""
        begin, end = int(self.offsets[first]) * self.width, int(self.offsets[last]) * self.width
        return self.source.read_at(end - begin, self.payload + begin)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of the documents with a key."""
        (first,), (count,) = self.rows_of(np.array([key], dtype=np.int64))
        return [np.frombuffer(self.read(r, r + 1), dtype=f"<u{self.width}") for r in range(first, first + count)]


class Store:
    """Keyed access to all shards. Holds the manifest, one row per shard, and the last OPEN_SHARDS shards used."""

    def __init__(self, manifest: DataFrame):
        rows = manifest.where("first_key IS NOT NULL").select("part", "seq", "file", "first_key", "last_key").orderBy("part", "seq").toArrow()
        self.files = rows.column("file").to_pylist()
        self.first, self.last = (rows.column(k).to_numpy() for k in ("first_key", "last_key"))
        self.open: dict[str, Shard] = {}

    def shard(self, file: str) -> Shard:
        found = self.open.pop(file, None) or Shard(file)
        self.open[file] = found
        if len(self.open) > OPEN_SHARDS:
            del self.open[next(iter(self.open))]
        return found

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of the documents with a key: two binary searches, and one shard unless the key's rows go on in the next."""
        low, high = np.searchsorted(self.last, key), np.searchsorted(self.first, key, side="right")
        return [ids for file in self.files[low:high] for ids in self.shard(file).get(key)]


def _write(path: str, vocabulary: str, keeps_space: bool, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary, keeps_space), TaskContext.get().partitionId()
        system, base = file_system(path)
        system.create_dir(base, recursive=True)
        width, end = encode.dtype.itemsize, np.array([end_id], dtype=encode.dtype).tobytes()
        keys, documents, held, done = [], [], 0, []

        def close() -> None:
            nonlocal keys, documents, held
            name, temporary = f"shard-{part:06d}-{len(done):04d}.ids", f".{uuid.uuid4().hex}"
            with system.open_output_stream(f"{base}/{temporary}") as out:
                for piece in pack_shard(keys, documents, width):
                    out.write(piece)
            system.move(f"{base}/{temporary}", f"{base}/{name}")
            keyed = [k for k in (keys[sum(k is None for k in keys) :][:1] + keys[-1:]) if k is not None] or [None, None]
            done.append((part, len(done), f"{path}/{name}", len(keys), held, keyed[0], keyed[-1]))
            keys, documents, held = [], [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for key, ids in zip(some.column("doc_id").to_pylist(), encode.encode(some.column("text").to_pylist()), strict=True):
                    keys.append(key)
                    documents.append(ids + end)
                    held += len(ids) // width + 1
                    if held >= SHARD_IDS:
                        close()
        if keys:
            close()
        columns = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "file", "rows", "ids", "first_key", "last_key"])

    return write


def write_ids(docs: DataFrame, vocabulary: str, path: str | None = None, keeps_space: bool = True, end_id: int = 2) -> DataFrame:
    """Encode every document and write id shards in ascending doc_id order; the manifest, one row per shard.

    The rows are range-partitioned by doc_id (then by a hash of the text, so that a key with very many
    rows spreads over partitions) before they are encoded: texts move once and are encoded once.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/ids"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(sized_partitions(docs, TASK_BYTES), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return stored(ordered.select("doc_id", "text").mapInArrow(_write(path, vocabulary, keeps_space, end_id), MANIFEST))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item in batch.to_pylist():
            shard = Shard(item["file"])
            # Rows without a key in their order; all others by looking their keys up in the index.
            keys = np.unique(shard.keys[shard.nulls :])
            first, count = shard.rows_of(keys)
            order = np.argsort(first, kind="stable")
            rows = np.concatenate((np.arange(shard.nulls), np.repeat(first[order], count[order]) + _within(count[order])))
            named = np.concatenate((np.zeros(shard.nulls, dtype=np.int64), np.repeat(keys[order], count[order])))
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                ids = [np.frombuffer(shard.read(r, r + 1), dtype=f"<u{shard.width}").astype("<u4").tobytes() for r in part.tolist()]
                key = pa.array(named[at : at + 512], mask=part < shard.nulls)
                size = np.diff(shard.offsets)[part]
                yield pa.RecordBatch.from_arrays([key, pa.array(item["base"] + shard.offsets[part]), pa.array(size), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def read_ids(manifest: DataFrame) -> DataFrame:
    """Documents of all shards: doc_id, start (ids of all documents before), n_tokens, ids (32-bit little-endian).

    Only the manifest, one row per shard of up to SHARD_IDS ids, passes through the ordered window.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "seq", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return files.repartition(partitions(manifest.sparkSession), "part", "seq").mapInArrow(_read, READ)
