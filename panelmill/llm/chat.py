"""Chat formatting by columnar byte assembly.

A conversation becomes one text. Each turn is ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and
texts ``\\`` is written ``\\\\`` and ``<|`` is written ``<\\|``, in roles a new line is ``\\n``, so a template marker can only come from
the template and the original text can be read back. The loss mask covers the assistant's texts.

The bytes are laid out by numpy: the lengths of all segments give cumulative offsets, and every
segment is scattered to its place in one preallocated buffer that becomes an Arrow string column.

Defined results: a null role or text is empty; turns with equal numbers are ordered by role, then
text; a null turn comes first; a null conv_id is a conversation of its own; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import text_or_empty

OPEN, BREAK, CLOSE = b"<|turn|>", b"\n", b"<|end|>\n"
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_begin array<long>, loss_end array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "<|", "<\\|")


def escape_role(column: pa.Array) -> pa.Array:
    """A role ends at the first new line, so its own ones are written out."""
    return pc.replace_substring(escape(column), "\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S) if "\\" in role else role


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets, counted from 0, and the bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn begins (with the end), and where its text begins and ends."""
    (role_at, role_bytes), (text_at, text_bytes) = _bytes_of(escape_role(role)), _bytes_of(escape(text))
    turns, role_len, text_len = len(role), np.diff(role_at), np.diff(text_at)
    turn_at = np.concatenate(([0], np.cumsum(role_len + text_len + len(OPEN) + len(BREAK) + len(CLOSE))))
    buffer = np.empty(turn_at[-1], dtype=np.uint8)
    role_to = turn_at[:-1] + len(OPEN)
    text_to = role_to + role_len + len(BREAK)
    for place, fixed in ((turn_at[:-1], OPEN), (role_to + role_len, BREAK), (text_to + text_len, CLOSE)):
        buffer[place[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, dtype=np.uint8)
    for place, lengths, at, data in ((role_to, role_len, role_at, role_bytes), (text_to, text_len, text_at, text_bytes)):
        if turns and len(data):
            buffer[np.repeat(place - at[:-1], lengths) + np.arange(len(data))] = data
    return buffer, turn_at, text_to, text_to + text_len


class _Conversation:
    """Parts of the conversation that may go on in the next batch."""

    def __init__(self, key: int | None):
        self.key, self.turns, self.size, self.parts, self.begin, self.end = key, 0, 0, [], [], []

    def add(self, part: bytes, turns: int, begin: np.ndarray, end: np.ndarray) -> None:
        self.parts.append(part)
        self.begin.append(begin + self.size)
        self.end.append(end + self.size)
        self.turns += turns
        self.size += len(part)


def _rows(done: list[_Conversation]) -> pa.RecordBatch:
    text = pa.array([b"".join(c.parts) for c in done], pa.binary()).cast(pa.string())
    spans = [pa.array([np.concatenate(getattr(c, k)) for c in done], pa.list_(pa.int64())) for k in ("begin", "end")]
    keys, turns = pa.array([c.key for c in done], pa.int64()), pa.array([c.turns for c in done], pa.int64())
    return pa.RecordBatch.from_arrays([keys, turns, text, *spans], ["conv_id", "n_turns", "formatted", "loss_begin", "loss_end"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of turns, sorted by conversation and turn, to conversations. Loss spans count bytes."""
    last: _Conversation | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, role = batch.column("conv_id"), batch.column("role")
        buffer, turn_at, begin, end = assemble(role, batch.column("text"))
        loss = pc.equal(role, LOSS_ROLE).to_numpy(zero_copy_only=False)
        values, missing = key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (missing[1:] != missing[:-1]))))
        done = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(values)], strict=True):
            k = None if missing[a] else int(values[a])
            if last is None or last.key != k:
                if last is not None:
                    done.append(last)
                last = _Conversation(k)
            base, mask = turn_at[a], loss[a:b]
            last.add(buffer[base : turn_at[b]].tobytes(), b - a, begin[a:b][mask] - base, end[a:b][mask] - base)
        if done:
            yield _rows(done)
    if last is not None:
        yield _rows([last])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_begin, loss_end.

    The loss spans are byte positions in the UTF-8 form of ``formatted``. Turns are shuffled by
    conversation and stream through the task in order, so a task holds one batch and the
    conversation that is being written, never a whole partition. One conversation has to fit in a task's memory.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), text_or_empty().alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    turns = []
    for part in formatted.split("<|turn|>")[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: -len("<|end|>\n")])))
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns, raw = parse(row["formatted"]), row["formatted"].encode()
            loss = [unescape(raw[b:e].decode()) for b, e in zip(row["loss_begin"], row["loss_end"], strict=True)]
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append((row["conv_id"], len(turns), whole, sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(row["formatted"])))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of turns and loss text, read back from formatted conversations."""
    return formatted.mapInArrow(_digest, DIGEST)
