"""Words of whole Arrow string columns, hashed by numpy without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            row = np.full(size, base, dtype=U64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row)
    return _POWERS["up"], _POWERS["down"]


def separators(white_space_only: bool) -> np.ndarray:
    """Which bytes separate words: ASCII white space, or every ASCII byte that is no letter or digit."""
    out = np.zeros(256, dtype=bool)
    if white_space_only:
        out[[0x20, *range(0x09, 0x0E)]] = True
    else:
        out[:128] = [not chr(b).isalnum() for b in range(128)]
    return out


def _table(separator: np.ndarray) -> np.ndarray:
    """Value of each byte: 0 for separators; A-Z count as a-z."""
    value = np.arange(1, 257, dtype=U64)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    value[separator] = 0
    return value


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets counted from 0, and bytes, of a string or binary column whose nulls are empty."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def hashed_words(offsets: np.ndarray, data: np.ndarray, white_space_only: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word counts by row, word hashes) for blocks of rows, in order.

    Every row lies whole in one block, so a block is BLOCK bytes or one row.
    """
    separator = separators(white_space_only)
    value = _table(separator)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        part, edge = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        yield (at, to, *_block(part, edge, separator, value))
        at = to


def _block(part: np.ndarray, edge: np.ndarray, separator: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(part)
    if not n:
        return np.zeros(len(edge) - 1, dtype=np.int64), np.zeros(0, dtype=U64)
    inside = ~separator[part]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    opening = edge[:-1][np.diff(edge) > 0]
    begins[opening] = inside[opening]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, edge))
    if not len(starts):
        return counts, np.zeros(0, dtype=U64)
    up, down = _powers(n + 1)
    sums = np.add.reduceat(value[part] * up[:n], starts)
    return counts, mix(sums * down[starts])


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of width words, and their number by row; a shorter row is one run, an empty one none."""
    edge = np.concatenate(([0], np.cumsum(counts)))
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not len(words):
        return np.zeros(0, dtype=U64), number
    padded = np.concatenate((words, np.zeros(width, dtype=U64)))
    first = np.repeat(edge[:-1], number) + (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
    left = np.repeat(edge[1:], number) - first
    total = np.zeros(len(first), dtype=U64)
    for i in range(width):
        total = total * _BASE + np.where(i < left, padded[first + i], U64(i + 1))
    return mix(total), number
