"""SentencePiece encoding with byte spans, and decoding.

A text is normalised here: at each place the longest key of the model's compiled character map is
replaced, other characters stay, and a blank becomes the model's blank mark. The normaliser keeps, for each
byte it writes, the byte of the text it came from. The library then cuts the normalised text (through the same
model, with its own normaliser switched off), and the lengths of the pieces lead from the normalised bytes back to
the text. Piece k covers the bytes bounds[k] to bounds[k + 1] of the text, so the spans of all pieces lie end to end;
a blank mark that the model puts before the text, and all but the last byte piece of a character, cover nothing.

Work is done text by text within a task; batches of results hold about BATCH_BYTES of text or one text.

Defined results: a null text is empty, an empty text has no pieces and decodes to an empty text; rows are kept as they
are, also those with null or equal keys; all columns of the input but ids and bounds (text: decode_pieces) pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from panelmill.llm.common import text_or_empty

BLANK = "▁"
BATCH_BYTES = 4 << 20
#: Kinds of pieces in a model file.
USER_DEFINED, BYTE = 4, 6


def map_entries(compiled: bytes) -> dict[bytes, bytes]:
    """Keys and replacements of a compiled character map.

    The map is a double array (32-bit units: a label in the low byte, an offset from bit 10, scaled by 256 if bit 9 is
    set, bit 8 if a key ends here) before the replacements, which end with a zero byte. All keys are listed by walking it.
    """
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units, texts = np.frombuffer(compiled[4 : 4 + size], dtype="<u4").astype(np.int64), compiled[4 + size :]
    reach = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    labels, found = np.arange(1, 256), {}
    bases, keys = np.array([reach(units[0])]), [b""]
    while len(bases):
        below, longer = [], []
        for cut in range(0, len(bases), 4096):
            at = bases[cut : cut + 4096, None] ^ labels
            node, byte = np.nonzero((at < len(units)) & (units[np.minimum(at, len(units) - 1)] & 0x800000FF == labels))
            place = at[node, byte]
            next_base = place ^ reach(units[place])
            for i, letter, base, ends in zip((node + cut).tolist(), labels[byte].tolist(), next_base.tolist(), (units[place] & 0x100).tolist(), strict=True):
                key = keys[i] + bytes([letter])
                if ends:
                    begin = int(units[base]) & 0x7FFFFFFF
                    found[key] = texts[begin : texts.index(b"\0", begin)]
                longer.append(key)
            below.append(next_base)
        bases, keys = np.concatenate(below), longer
    return found


class Normaliser:
    """Longest-prefix replacement with the source of every byte that is written."""

    def __init__(self, compiled: bytes = b"", kept: tuple[str, ...] = (), leading_blank: bool = True, trailing_blank: bool = False, squeeze: bool = False, mark_blanks: bool = True):
        """kept: symbols that stay as they are. squeeze: drop blanks at both ends and all but one in between."""
        table = {k.decode(): v.decode() for k, v in map_entries(compiled).items()}
        self.table, self.squeeze = table, squeeze
        self.leading, self.trailing = leading_blank and not trailing_blank, leading_blank and trailing_blank
        self.blank = BLANK.encode() if mark_blanks else b" "
        #: All keys, longest first for a first character; kept symbols come before the map's.
        self.keys: dict[str, list[tuple[str, str]]] = {}
        for key, value in [*((k, k) for k in sorted(kept, key=len, reverse=True)), *sorted(table.items(), key=lambda e: -len(e[0]))]:
            self.keys.setdefault(key[0], []).append((key, value))
        self.opening = re.compile("[" + re.escape("".join(self.keys)) + "]") if self.keys else None

    def _plain(self, raw: bytes, begin: int) -> tuple[bytes, np.ndarray]:
        """Bytes that no key touches, and where their characters begin in the text."""
        data = np.frombuffer(raw, dtype=np.uint8)
        at = np.maximum.accumulate(np.where(data & 0xC0 != 0x80, np.arange(len(data)), 0)) + begin
        return raw.replace(b" ", self.blank), np.repeat(at, np.where(data == 0x20, len(self.blank), 1)) if len(self.blank) > 1 else at

    def _parts(self, text: str) -> Iterator[tuple[str, str]]:
        """The text cut into (source, replacement), longest key first; runs that no key touches come whole."""
        at = 0
        while at < len(text):
            found = self.opening.search(text, at) if self.opening else None
            stop = found.start() if found else len(text)
            if stop > at:
                yield text[at:stop], text[at:stop]
            at = stop
            if found:
                key, value = next((e for e in self.keys[text[at]] if text.startswith(e[0], at)), (text[at], text[at]))
                yield key, value
                at += len(key)

    def _squeezed(self, parts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
        """Parts without blanks behind blanks (or at the begin), character by character where a part has blanks."""
        after = True
        for source, value in parts:
            whole = source == value
            for s, v in zip(source, value, strict=True) if whole and (" " in value) else [(source, value)]:
                while after and v[:1] == " ":
                    v = v[1:]
                yield s, v
                if v:
                    after = v[-1] == " "

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) the byte of the text."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        out, source, consumed, begin = [], [], 0, None
        parts = self._squeezed(self._parts(text)) if self.squeeze else self._parts(text)
        for taken, value in parts:
            raw = taken.encode()
            begin = consumed if begin is None and value else begin
            if value == taken:
                written, places = self._plain(raw, consumed)
            else:
                written = value.encode().replace(b" ", self.blank)
                places = np.full(len(written), consumed)
            out.append(written)
            source.append(places)
            consumed += len(raw)
        normal, places = b"".join(out), np.concatenate(source)
        if self.squeeze:
            while normal.endswith(self.blank):
                consumed = int(places[len(normal) - len(self.blank)])
                normal = normal[: -len(self.blank)]
            places = places[: len(normal)]
            if not normal:
                return b"", np.full(1, consumed)
        if self.leading:
            normal, places = self.blank + normal, np.concatenate((np.full(len(self.blank), begin or 0), places))
        if self.trailing:
            normal, places = normal + self.blank, np.concatenate((places, np.full(len(self.blank), consumed)))
        return normal, np.append(places, consumed)


class Pieces:
    """A model: its normaliser, the library's cutter behind it, and the library's decoder."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        kept = tuple(p.piece for p in proto.pieces if p.type == USER_DEFINED)
        self.normalise = Normaliser(spec.precompiled_charsmap, kept, spec.add_dummy_prefix, proto.trainer_spec.treat_whitespace_as_suffix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.sizes = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.decoder = SentencePieceProcessor(model_proto=model)
        self.unknown = self.decoder.unk_id()
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.cutter = SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: ids, and one byte position more than ids (where each piece begins in the UTF-8 text, and the end)."""
        normal = [self.normalise(t) for t in texts]
        done = []
        for (raw, places), ids in zip(normal, self.cutter.encode([raw for raw, _ in normal], return_type="numpy", num_threads=1) if texts else [], strict=True):
            ids = np.asarray(ids, dtype=np.int32)
            sizes = self.sizes[ids]
            if (ids == self.unknown).any():
                surfaces = self.cutter.encode(raw, return_type=str, num_threads=1)
                sizes = np.array([len(p.encode()) if i == self.unknown else n for i, n, p in zip(ids, sizes, surfaces, strict=True)], dtype=np.int64)
            edges = np.concatenate(([0], np.cumsum(sizes)))
            if edges[-1] != len(raw):
                raise ValueError("the pieces do not cover the normalised text")
            done.append((ids, places[edges].astype(np.int32)))
        return done

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.decoder.decode(ids, num_threads=1) if ids else []


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """The model of this Python process; it lives as long as the worker does."""
    with open(path, "rb") as file:
        return Pieces(file.read())


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of at most BATCH_BYTES, or of one row."""
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size + sizes[to] <= BATCH_BYTES):
            size += sizes[to]
            to += 1
        yield at, to
        at = to


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """The rows of docs with ids and bounds in place of text.

    path: the model file, at the same place on every machine. The i-th piece covers the bytes bounds[i] to bounds[i + 1] of the text.
    """
    kept = [c for c in docs.columns if c not in ("text", "ids", "bounds")]
    schema = StructType([*(docs.schema[c] for c in kept), *(StructField(c, ArrayType(IntegerType(), False)) for c in ("ids", "bounds"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            column = batch.column("_text").cast(pa.large_string())
            sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]).tolist() if len(column) else []
            for a, b in _groups(sizes):
                done = model.encode(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), _lists([i for i, _ in done]), _lists([s for _, s in done])], [*kept, "ids", "bounds"])

    return docs.select(*(F.col(f"`{c}`") for c in kept), text_or_empty().alias("_text")).mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """Add text, decoded by the library from ids (null ids: empty), to rows of ids."""
    schema = StructType([*(f for f in encoded.schema if f.name != "text"), StructField("text", StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            ids = batch.column("ids")
            sizes = (4 * ids.value_lengths().fill_null(0).to_numpy()).tolist()
            for a, b in _groups(sizes):
                part = ids.slice(a, b - a)
                texts = model.decode(np.split(part.flatten().to_numpy(), np.cumsum(part.value_lengths().fill_null(0).to_numpy())[:-1]))
                columns = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name).slice(a, b - a) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return encoded.mapInArrow(decode, schema)


def piece_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and covered_bytes (the bytes of the text that the spans cover)."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
        (F.element_at("bounds", -1) - F.element_at("bounds", 1)).cast("long").alias("covered_bytes"),
    )
