"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may appear with up to k = floor(m * rate) edits. It is split into k + 1 pieces;
whatever k edits do, one piece survives unchanged, so every occurrence holds an exact piece. All
pieces of all items are found in one pass over each whole text (Aho-Corasick). Each hit proposes the
place where its item would begin, and Myers' bit-parallel edit distance decides there.

Texts and items are compared lower-cased, with every white-space character as a space; positions are
those of the original text.

The items are the stated query set: they are written to the shared folder in groups of about GROUP_CHARS
characters, one pass over the documents for each group; each Python worker reads the group of its
pass there, so neither the driver nor a closure ever holds the benchmark, and a task holds one group.

Items below SHORT_CHARS characters occur in ordinary text, so they are searched without edits and as whole words.

Defined results: null or empty texts hold nothing; null items, those of white space alone and those with a null item_id
are not searched; item_id has to be an integer; items with equal text are each reported; a repeated row is
searched each by itself; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelmill.llm.common import file_system, shared_dir, text_or_empty

RATE, SHORT_CHARS = 0.05, 24
GROUP_CHARS = 8_000_000
_SPACE = re.compile(r"[^\S ]")
LEAKS = "doc_id long, item_id long, begin long, end long, distance int"


def normal(text: str) -> str:
    """Lower case and plain spaces, character by character, so that positions stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return _SPACE.sub(" ", low)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces that cover the item, with their places; lengths differ by one at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the pattern anywhere in text, first of equals; None above k."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """All items of one group, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(key, text, int(len(text) * rate) if len(text) >= SHORT_CHARS else 0, masks_of(text), masks_of(text[::-1])) for key, text in items]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, k, _, _) in enumerate(self.items):
            for place, piece in pieces(text, k):
                found.setdefault(piece, []).append((number, place + len(piece) - 1))
        for piece, owners in found.items():
            self.automaton.add_word(piece, owners)
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def search(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item key, begin, end, distance) of the occurrences in a text, in order."""
        if not raw or not self.any:
            return []
        text, proposed = normal(raw), {}
        for end, owners in self.automaton.iter(text):
            for number, place in owners:
                proposed.setdefault(number, set()).add(end - place)
        out = []
        for number, starts in proposed.items():
            key, item, k, forward, backward = self.items[number]
            m, done = len(item), -1
            for begin in sorted(starts):
                # Proposed beginnings within the budget of each other are one occurrence; it is judged with
                # room for the budget on both sides.
                if begin <= done:
                    continue
                low, high = max(0, begin - k), min(len(text), begin + 2 * k + m + 1)
                match = myers(forward, m, text[low:high], k)
                if match is None:
                    done = begin
                    continue
                stop = low + match[1]
                back = myers(backward, m, text[max(0, stop - m - k) : stop][::-1], match[0])
                start = stop - (back[1] if back else m)
                if m < SHORT_CHARS and (text[start - 1 : start].isalnum() or text[stop : stop + 1].isalnum()):
                    continue
                out.append((key, start, stop, match[0]))
                done = max(begin, stop - m + k)
        return sorted(set(out), key=lambda r: (r[1], r[0], r[2]))


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(folder: str, rate: float) -> Matcher:
    """The matcher of this Python process for a group of items, read from its folder."""
    if (folder, rate) not in _MATCHERS:
        _MATCHERS.clear()
        system, path = file_system(folder)
        rows = pq.read_table(path, filesystem=system, columns=["item_id", "text"], partitioning=None)
        items = [(k, normal(t)) for k, t in zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True) if t.strip()]
        _MATCHERS[folder, rate] = Matcher(sorted(items), rate)
    return _MATCHERS[folder, rate]


def item_groups(benchmark: DataFrame) -> list[str]:
    """Folders of the groups of items. Their number follows the size of the benchmark, which is counted first."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    number, base = -(-size // GROUP_CHARS), f"{shared_dir(spark)}/items"
    if number:
        group = F.pmod(F.xxhash64("item_id", "text"), F.lit(number).cast("long"))
        rows.withColumn("item_group", group).repartition("item_group").write.partitionBy("item_group").parquet(base)
    present = [r[0] for r in spark.read.parquet(base).select("item_group").distinct().collect()] if number else []
    return [f"{base}/item_group={g}" for g in sorted(present)]


def _search(folder: str, rate: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(folder, rate)
        for batch in batches:
            found = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in matcher.search(text)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "begin", "end", "distance"])

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per occurrence of a benchmark item: doc_id, item_id, begin, end, distance."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for folder in item_groups(benchmark):
        out = out.unionByName(texts.mapInArrow(_search(folder, rate), LEAKS))
    return out


def holds_leak(folder: str, rate: float = RATE, text: str = "text") -> Column:
    """Whether a text holds an item of the group in a folder."""

    @pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        matcher = _matcher(folder, rate)
        return pd.Series([bool(t) and bool(matcher.search(t)) for t in texts], index=texts.index, dtype=bool)

    return holds(F.col(text))


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows and columns of docs, less the documents that hold a benchmark item."""
    for folder in item_groups(benchmark):
        docs = docs.where(~holds_leak(folder, rate))
    return docs
