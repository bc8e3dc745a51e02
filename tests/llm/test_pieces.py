"""SentencePiece ids, spans and decoding against the library, for this and other normalisers."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm import pieces, registry

PATH = registry.vocabulary("piece_bpe_32k.model")
HARD = ["", " ", "   ", "  Ａｂ  ﬁ①\x00é🙂 x\n\n\ty　 ", "　　a", "é à́ ｶﾞ ", "가각", "ﬀ ffi ㈱  ​ x ﻿", "▁ a▁▁b", "<s> </s> <unk> <0x41>", "a" * 300, "no  double   blanks "]


def library(model=None):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH) if model is None else SentencePieceProcessor(model_proto=model)


def same(own, lib, text):
    ((ids, bounds),) = own.encode([text])
    cut = lib.encode(text, return_type="proto").pieces
    assert ids.tolist() == [p.id for p in cut]
    assert [(p.begin, p.end) for p in cut] == list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    return ids


def changed(rule=None, squeeze=False, suffix=False, prefix=True, kept=(), fallback=True):
    """The model with another normaliser (the compiled map that the library ships), or symbols of its own."""
    from sentencepiece import SentencePieceNormalizer
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    if rule:
        other = schema.ModelProto()
        other.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix, proto.trainer_spec.treat_whitespace_as_suffix = squeeze, prefix, suffix
    for at, symbol in enumerate(kept):
        proto.pieces[1000 + at].piece, proto.pieces[1000 + at].type = symbol, pieces.USER_DEFINED
    if not fallback:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == pieces.BYTE:
                p.piece, p.type = f"<byte{p.piece}", 5
    return proto.SerializeToString()


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_spans_and_decoding_equal_the_library(text):
    own, lib = pieces.pieces(PATH), library()
    ids = same(own, lib, text)
    assert own.decode([ids]) == [lib.decode(ids.tolist())]


@pytest.mark.parametrize("options", [{"rule": "nfkc", "squeeze": True}, {"rule": "nmt_nfkc_cf", "suffix": True}, {"squeeze": True, "prefix": False}, {"rule": "nmt_nfkc", "squeeze": True, "suffix": True}, {"fallback": False}])
def test_other_normalisers(options):
    model = changed(**options)
    own, lib = pieces.Pieces(model), library(model)
    for text in HARD:
        same(own, lib, text)


def test_kept_symbols_are_not_normalised():
    model = changed("nfkc", kept=("①②", "Ａ"))
    own, lib = pieces.Pieces(model), library(model)
    for text in ["①② ① Ａ b", "x①②②Ａ"]:
        same(own, lib, text)


def test_whole_documents_equal_the_library(spark):
    path, lib = "/root/testdata/sf0.01", library()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = registry.op13_pieces(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]])
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["covered_bytes"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), len(texts[r["doc_id"]].encode()))


def test_awkward_documents(spark, awkward, no_docs, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_BYTES", 50)
    docs = awkward.withColumn("bounds", awkward.n_chars)
    encoded = pieces.encode_pieces(docs, PATH)
    assert encoded.columns == ["doc_id", "lang", "source", "n_chars", "score", "shard", "origin", "tie", "ids", "bounds"]
    rows = pieces.decode_pieces(encoded, PATH).collect()
    lib = library()
    assert sorted(r["text"] for r in rows) == sorted(lib.decode(lib.encode(r["text"] or "")) for r in awkward.collect())
    assert all(len(r["bounds"]) == len(r["ids"]) + 1 for r in rows)
    assert {r["n_tokens"] for r in pieces.piece_digests(pieces.decode_pieces(encoded, PATH)).where("doc_id = 2 OR doc_id = 3").collect()} == {0}
    assert pieces.encode_pieces(no_docs, PATH).count() == 0 and pieces.decode_pieces(pieces.encode_pieces(no_docs, PATH), PATH).count() == 0
