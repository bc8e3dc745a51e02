"""Packing, id store and sharding against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelmill.llm import idstore, packing, registry, sharding
from panelmill.llm.tokens import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


def whole_ids(path, texts, end):
    t = Tokenizer.from_file(path)
    return [np.array([*e.ids, end], dtype="<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("path", "keeps"), [(WORD, False), (BYTE, True)])
def test_pieces_give_the_same_ids_as_whole_texts(path, keeps):
    codec = PieceEncoder(path, keeps, remembered=50)
    reference = Tokenizer.from_file(path)
    alphabet = ["a", "B", "é", "ß", "'s", " ", "  ", "\n", "\t", "\xa0", "12", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "!", "...", "ΑΣ", chr(0x301), "日本", "🙂", "\x1c", "the", chr(0x200B)]

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(alphabet), max_size=14).map("".join), max_size=6))
    def same(texts):
        want = [np.array(e.ids, dtype="<u2").tobytes() for e in reference.encode_batch(texts, add_special_tokens=False)]
        assert codec.encode(texts) == want

    same()


def test_packing_holds_each_id_once(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = dict(zip(docs, whole_ids(WORD, list(docs.values()), 1), strict=True))
    rows = registry.op2_packing(spark, SMALL).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
    assert set(by_doc) == set(docs)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(want[doc])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_packing_of_awkward_rows(spark, awkward, no_docs):
    rows = packing.pack_documents(awkward, WORD).collect()
    want = sum(len(x) for x in whole_ids(WORD, [r["text"] or "" for r in awkward.collect()], 1))
    assert sum(r["length"] for r in rows) == want
    assert sum(1 for r in rows if r["doc_id"] == 3) == 1
    assert packing.pack_documents(no_docs, WORD).count() == 0


def test_hilbert_key_walks_to_neighbours():
    side = 4
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert_key(points, bits=2)
    assert sorted(key) == list(range(side**3))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_id_store_against_whole_encoding(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want, at = [], 0
    for (doc, _), ids in zip(docs, whole_ids(BYTE, [t for _, t in docs], 2), strict=True):
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, registry.op9_idstore(spark, SMALL).collect())) == want


def test_id_store_of_awkward_rows(spark, awkward, no_docs):
    manifest = idstore.write_ids(awkward, BYTE)
    rows = idstore.read_ids(manifest).collect()
    want = Counter((r["doc_id"], ids.tobytes()) for r, ids in zip(awkward.collect(), whole_ids(BYTE, [r["text"] or "" for r in awkward.collect()], 2), strict=True))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1])
    keys = [r["doc_id"] for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert idstore.read_ids(idstore.write_ids(no_docs, BYTE)).count() == 0


def test_keyed_access(spark, awkward, monkeypatch):
    monkeypatch.setattr(idstore, "OPEN_SHARDS", 2)
    manifest = idstore.write_ids(awkward, BYTE)
    store = idstore.Store(manifest)
    want = defaultdict(list)
    for r, ids in zip(awkward.collect(), whole_ids(BYTE, [r["text"] or "" for r in awkward.collect()], 2), strict=True):
        want[r["doc_id"]].append(ids.tolist())
    for key in {*want} - {None}:
        assert sorted(x.tolist() for x in store.get(key)) == sorted(want[key])
    assert store.get(123456) == [] and store.get(-123456) == []
    assert len(store.open) <= 2
    assert all(r["first_key"] <= r["last_key"] for r in manifest.where("first_key IS NOT NULL").collect())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), dtype=np.int64)
    slots = idstore.PerfectHash.build(keys).slots(keys)
    assert sorted(slots) == list(range(len(keys)))


def test_shards_are_whole_and_grow_into_the_new_one(spark):
    rows = registry.op3_sharding(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    slots = defaultdict(list)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_splits_a_hot_key_and_repeats_itself(spark, awkward, no_docs):
    hot = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    once = sharding.with_slots(sharding.write_shards(hot, sharding.shared_dir(spark), shards=4, bucket_bytes=4096))
    rows = once.collect()
    assert len({r["shard"] for r in rows}) == 1 and len({r["bucket"] for r in rows}) > 5
    assert sorted(r["slot"] for r in rows) == list(range(3000))
    again = sharding.with_slots(sharding.write_shards(hot, sharding.shared_dir(spark), shards=4, bucket_bytes=4096))
    assert {(r["text"], r["slot"]) for r in rows} == {(r["text"], r["slot"]) for r in again.collect()}
    kept = sharding.shard_records(awkward).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter((r["doc_id"], r["text"]) for r in awkward.collect())
    assert sharding.shard_records(no_docs).count() == 0
