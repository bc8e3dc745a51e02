"""Scoring by a hierarchical Pitman-Yor language model.

Tokens are runs without ASCII white space, A-Z lower-cased, and one end token per text. The context of
a token is the token before it; at the start of a text that is the end token. Every context word has
a restaurant of its own, and all of them share one parent, the restaurant of single words, over a base
distribution: UNKNOWN of its mass is for one type that stands for all words never seen in training,
the rest is uniform over the words seen. So the number of contexts grows with the corpus.

Seating: the customers of a context's restaurant are the training tokens behind that word; each table
sends one customer to the parent. One step of Gibbs sampling reseats a dish as a block: a new seating
of all its customers is drawn one after another by the Chinese-restaurant probabilities (the number of
customers until the next new table is drawn at once, from its exact distribution), and taken by the
Metropolis rule, which makes the step exact for the dish given the others. What is approximate is
that all dishes are reseated side by side, given the tables of the others as the last sweep left them, and
that a seating of the parent is cut or extended at its end where its number of customers has changed.
A word seen once behind a context sits alone and needs no step. The predictive probabilities of the
last KEPT sweeps are averaged.

Work on the cluster: a chunk of documents becomes its distinct words and the documents as numbers of
those. Buckets of words name each word by its rank there. Then the chunk's distinct pairs go to buckets by
context, a context beyond HOT customers to several (dealt by the word); buckets of pairs hold seatings
of pairs, buckets of words those of the parent and the totals of contexts. A sweep sends tables one way and
totals back, only for pairs seen twice or more. In the end each chunk gets the tables of its words and
pairs. Only totals over all buckets reach the driver. A chunk is bounded by CHUNK_TOKENS tokens (or one
document), a bucket by the number of buckets, which follows the counted bytes of the input. A chunk sends
a frequent pair once, however often it occurs there.

Defined results: a null text is empty and has the end token only; rows with a null key are scored but
never learned from and have a null held_out; repeated rows count and are scored each by itself;
without training text every token is unknown and has probability 1; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import drop_stored, fold, partitions, release_shuffles, stored, text_or_empty
from panelmill.llm.words import U64, hashed_words, mix, string_parts

SWEEPS, KEPT = 4, 2
STRENGTH = 5.0
UNKNOWN = 0.9
CHUNK_TOKENS = 1 << 21
#: Customers of a context for each of its buckets, and bytes of text for which there is one bucket of words and of pairs.
HOT, BUCKET_BYTES = 1 << 20, 8 << 20
END = U64(0x5EED_0E4D_0F7E_1701)
CHUNKS = "chunk long, bucket int, words binary, counts binary, doc_ids binary, missing binary, held binary, learn binary, sizes binary, tokens binary"
NAMED = "chunk long, bucket int, ids binary, counts binary, tokens long, types long"
LISTS = "chunk long, bucket int, us binary, spread binary, ws binary, counts binary"
PAIRS = "bucket int, us binary, spread binary, ws binary, counts binary, once long, twice long"
#: A bucket of pairs (part -1) and what it sends to buckets of words (part). Open pairs are those seen twice or more.
SEATED = "bucket int, part int, us binary, spread binary, ws binary, counts binary, tables binary, times binary, sums binary, ranks binary, customers binary, seats binary, asked binary"
#: A bucket of words (part -1) and what it sends to buckets of pairs (part).
PARENTS = "bucket int, part int, counts binary, behind binary, ahead binary, customers binary, seats binary, tables binary, times binary, all_customers long, all_tables long, once long, twice long"
ANSWERS = "chunk long, bucket int, kind int, counts binary, sums binary, customers binary, seats binary, tables binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers (or any 64 bits) as compressed byte planes of the least width that holds them."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return b"%d" % width + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    width = int(raw[:1])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    fresh = np.zeros(len(sorted_keys[0]), dtype=bool)
    fresh[:1] = True
    for k in sorted_keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def pack_pairs(u: np.ndarray, w: np.ndarray) -> dict:
    """Pairs sorted by u, then w, as differences."""
    starts = _starts(u)
    steps = np.diff(w, prepend=0)
    steps[starts] = w[starts]
    return {"us": packed(np.diff(u[starts], prepend=0)), "spread": packed(np.diff(np.append(starts, len(u)))), "ws": packed(steps)}


def unpack_pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    us, spread, w = np.cumsum(unpacked(row["us"])), unpacked(row["spread"]), np.cumsum(unpacked(row["ws"]))
    starts = np.cumsum(spread) - spread
    before = np.concatenate(([0], w[starts[1:] - 1])) if len(starts) else starts
    return np.repeat(us, spread), w - np.repeat(before, spread)


def _rows(ddl: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], kinds[t]) for k, t in schema], [k for k, _ in schema])


def _table(ddl: str, rows: list[dict]) -> pa.Table:
    return pa.Table.from_batches([_rows(ddl, rows)])


# --- documents to chunks -----------------------------------------------------------------------------


class _Chunk:
    def __init__(self, number: int):
        self.number, self.tokens = number, 0
        self.words, self.facts = [], {k: [] for k in ("doc_ids", "missing", "held", "learn", "sizes")}

    def add(self, words: np.ndarray, counts: np.ndarray, **facts: np.ndarray) -> None:
        sizes = counts + 1
        out = np.full(int(sizes.sum()), END, dtype=U64)
        out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
        self.words.append(out)
        for k, v in (facts | {"sizes": sizes}).items():
            self.facts[k].append(v.astype(np.int64))
        self.tokens += len(out)

    def parts(self, buckets: int) -> Iterator[dict]:
        """The distinct words by bucket with their training counts, and the documents as numbers of words in that order."""
        facts = {k: np.concatenate(v) for k, v in self.facts.items()}
        known, number = np.unique(np.concatenate(self.words), return_inverse=True)
        order = np.argsort(known % U64(buckets), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        number, known = rank[number], known[order]
        counts = np.bincount(number, weights=np.repeat(facts["learn"], facts["sizes"]), minlength=len(known)).astype(np.int64)
        bucket = (known % U64(buckets)).astype(np.int64)
        starts = _starts(bucket)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(known)], strict=True):
            yield {"chunk": self.number, "bucket": int(bucket[a]), "words": known[a:b].astype("<u8").tobytes(), "counts": packed(counts[a:b])}
        yield {"chunk": self.number, "bucket": -1, "tokens": packed(number), **{k: packed(v) for k, v in facts.items() if k != "doc_ids"}, "doc_ids": facts["doc_ids"].astype("<i8").tobytes()}


def _split(buckets: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        chunk = _Chunk(number)
        for batch in batches:
            ids, missing = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            held, learn = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("held", "learn"))
            for a, b, counts, words in hashed_words(*string_parts(batch.column("text")), white_space_only=True):
                chunk.add(words, counts, doc_ids=ids[a:b], missing=missing[a:b], held=held[a:b], learn=learn[a:b])
                if chunk.tokens >= CHUNK_TOKENS:
                    for part in chunk.parts(buckets):
                        yield _rows(CHUNKS, [part])
                    number += 1
                    chunk = _Chunk(number)
        if chunk.tokens:
            for part in chunk.parts(buckets):
                yield _rows(CHUNKS, [part])

    return split


# --- buckets of words: names and counts ----------------------------------------------------------------


def _name(buckets: int):
    """The words of a bucket get the number rank * buckets + bucket, the most frequent first; words that training lacks get none.

    Numbers and counts travel one higher, 0 for none; the row of chunk -1 holds the counts by rank.
    """

    def name(key: tuple, rows: pa.Table) -> pa.Table:
        parts = sorted(rows.to_pylist(), key=lambda r: r["chunk"])
        known, at = np.unique(np.concatenate([np.frombuffer(r["words"], dtype="<u8") for r in parts]), return_inverse=True)
        counts = np.zeros(len(known), dtype=np.int64)
        np.add.at(counts, at, np.concatenate([unpacked(r["counts"]) for r in parts]))
        order, rank = np.lexsort((known, -counts)), np.empty(len(known), dtype=np.int64)
        rank[order] = np.arange(len(order))
        bucket = key[0].as_py()
        ids = np.where(counts > 0, rank * buckets + bucket + 1, 0)
        edges = np.cumsum([0, *(len(r["words"]) // 8 for r in parts)]).tolist()
        out = [{"chunk": r["chunk"], "bucket": bucket, "ids": packed(ids[at[a:b]]), "counts": packed(counts[at[a:b]])} for r, a, b in zip(parts, edges[:-1], edges[1:], strict=True)]
        seen = counts[order][: int((counts > 0).sum())]
        return _table(NAMED, [*out, {"chunk": -1, "bucket": bucket, "counts": packed(seen), "tokens": int(seen.sum()), "types": len(seen)}])

    return name


# --- chunks to pairs -----------------------------------------------------------------------------------


class _Pairs:
    """The distinct (context, word) pairs of a chunk, by its numbers of words; known ones ordered by bucket, context, word."""

    def __init__(self, rows: pa.Table, buckets: int):
        parts = sorted(rows.to_pylist(), key=lambda r: r["bucket"])
        self.facts, names = parts[0], [r for r in parts[1:] if r.get("ids") is not None]
        self.others = [r for r in parts[1:] if r.get("ids") is None]
        self.ids, self.counts = (np.concatenate([unpacked(r[k]) for r in names]) for k in ("ids", "counts"))
        self.ids -= 1
        self.sizes, tokens, n = unpacked(self.facts["sizes"]), unpacked(self.facts["tokens"]), len(self.ids)
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = tokens[-1]  # the end token closes every text
        key, self.place = np.unique(before * n + tokens, return_inverse=True)
        self.context, self.word = key // n, key % n
        u, w = self.ids[self.context], self.ids[self.word]
        known = np.flatnonzero((u >= 0) & (w >= 0))
        u, w = u[known], w[known]
        dealt = (mix(w.astype(U64)) % (1 + self.counts[self.context[known]] // HOT).astype(U64)) if len(w) else w.astype(U64)
        bucket = (mix(u.astype(U64) * U64(0x9E3779B97F4A7C15) + dealt) % U64(buckets)).astype(np.int64)
        order = np.lexsort((w, u, bucket))
        self.known, self.bucket, self.u, self.w = known[order], bucket[order], u[order], w[order]

    def lists(self) -> Iterator[dict]:
        learn = np.repeat(unpacked(self.facts["learn"]), self.sizes)
        counts = np.bincount(self.place, weights=learn, minlength=len(self.context)).astype(np.int64)[self.known]
        starts = _starts(self.bucket)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(self.bucket)] if len(starts) else [], strict=True):
            yield {"chunk": self.facts["chunk"], "bucket": int(self.bucket[a]), "counts": packed(counts[a:b]), **pack_pairs(self.u[a:b], self.w[a:b])}


def _lists(buckets: int):
    return lambda key, rows: _table(LISTS, list(_Pairs(rows, buckets).lists()))


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """The training counts of a bucket's pairs, summed over chunks."""
    parts = rows.to_pylist()
    u, w = (np.concatenate(x) for x in zip(*(unpack_pairs(r) for r in parts), strict=True))
    counts = np.concatenate([unpacked(r["counts"]) for r in parts])
    order = np.lexsort((w, u))
    u, w, counts = u[order], w[order], counts[order]
    starts = _starts(u, w)
    total = np.add.reduceat(counts, starts)
    seen = total > 0
    u, w, total = u[starts][seen], w[starts][seen], total[seen]
    return _table(PAIRS, [{"bucket": key[0].as_py(), **pack_pairs(u, w), "counts": packed(total), "once": int((total == 1).sum()), "twice": int((total == 2).sum())}])


# --- seating -------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series above 7."""
    low, z = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5) * (x + 6)), x + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def _damped(seated: np.ndarray, customers: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    """Log of the factor by which a draw opens fewer tables among the customers from one power of two to the next.

    A table more takes about the share discount * (1 - chance) / n from each later customer n, which the draw can't look ahead to.
    """
    middle = np.minimum(np.exp2(np.floor(np.log2(seated)) + 0.5), customers)
    return discount * (1 - chance) * np.log(middle / customers)


def forward_seating(customers: np.ndarray, other: np.ndarray, discount: float, chance: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of each dish, the numbers of the customers that open them but the first, and the log of the weight.

    other: strength + discount * (tables of the other dishes). Behind n others at t tables, opening a table has
    the weight (other + discount * t) * chance, here damped, against n - discount * t. The weight of a seating
    is how much likelier it is under the model than in the draw, but for a factor that all seatings share.
    """
    tables, seated, weight = np.ones(len(customers), dtype=np.int64), np.ones(len(customers), dtype=np.int64), np.zeros(len(customers))
    live, who, when = np.flatnonzero(customers > 1), [], []
    while len(live):
        t, n, c = tables[live], seated[live], customers[live]
        left = np.minimum(c, np.exp2(np.floor(np.log2(n)) + 1).astype(np.int64)) - n
        damped = _damped(n, c, discount, chance[live])
        a = n - discount * t
        b = a + (other[live] + discount * t) * chance[live] * np.exp(damped)
        stay = log_gamma(b) - log_gamma(a)
        luck = np.log(rng.random(len(live)))
        opens = stay + log_gamma(a + left) - log_gamma(b + left) < luck
        # Of those: the least number of further customers among which one opens a table.
        at, low, high = np.flatnonzero(opens), np.zeros(int(opens.sum()), dtype=np.int64), left[opens]
        while (high - low > 1).any():
            middle = (low + high) // 2
            early = stay[at] + log_gamma(a[at] + middle) - log_gamma(b[at] + middle) < luck[at]
            low, high = np.where(early, low, middle), np.where(early, middle, high)
        steps = left.copy()
        steps[at] = high
        weight[live] += log_gamma(b + steps) - log_gamma(b) - np.where(opens, damped, 0.0)
        seated[live] += steps
        tables[live[at]] += 1
        who.append(live[at])
        when.append(seated[live[at]])
        live = live[seated[live] < customers[live]]
    who, when = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (who, when))
    return tables, when[np.argsort(who, kind="stable")], weight


def seating_weight(customers: np.ndarray, tables: np.ndarray, times: np.ndarray, other: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    """The log of the weight of given seatings."""
    blocks = np.where(customers > 1, np.floor(np.log2(np.maximum(customers - 1, 1))).astype(np.int64) + 1, 0)
    block = np.repeat(np.arange(len(customers)), blocks)
    power = np.arange(len(block)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    opener = np.repeat(np.arange(len(customers)), tables - 1)
    dish, begin = np.concatenate((block, opener)), np.concatenate((np.int64(1) << power, times))
    opened = np.arange(len(dish)) >= len(block)
    order = np.lexsort((opened, begin, dish))
    dish, begin, opened = dish[order], begin[order], opened[order]
    last = np.flatnonzero(np.append(dish[1:] != dish[:-1], True)) if len(dish) else np.zeros(0, dtype=np.int64)
    stop = np.append(begin[1:], 0)
    stop[last] = customers[dish[last]]
    t = 1 + np.cumsum(opened) - np.repeat(np.cumsum(tables - 1) - (tables - 1), blocks + tables - 1)
    # A table that the customer n + 1 opens belongs to the block of n.
    damped = _damped(begin - opened, customers[dish], discount, chance[dish])
    here = _damped(begin, customers[dish], discount, chance[dish])
    b = begin - discount * t + (other[dish] + discount * t) * chance[dish] * np.exp(here)
    return np.bincount(dish, weights=log_gamma(b + (stop - begin)) - log_gamma(b) - np.where(opened, damped, 0.0), minlength=len(tables))


def cut_seating(customers: np.ndarray, tables: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seatings without the tables that customers beyond the present number opened."""
    dish = np.repeat(np.arange(len(tables)), tables - 1)
    kept = times <= customers[dish]
    return 1 + np.bincount(dish[kept], minlength=len(tables)), times[kept]


def reseat(customers: np.ndarray, tables: np.ndarray, times: np.ndarray, other: np.ndarray, discount: float, chance: np.ndarray, rng: np.random.Generator, fresh: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One Metropolis step for every dish: tables and opening customers. fresh: take the draw, as nothing is seated yet."""
    new_tables, new_times, new_weight = forward_seating(customers, other, discount, chance, rng)
    if fresh:
        return new_tables, new_times
    taken = np.log(rng.random(len(customers))) < new_weight - seating_weight(customers, tables, times, other, discount, chance)
    old, new = (np.repeat(np.arange(len(x)), x - 1) for x in (tables, new_tables))
    dish = np.concatenate((old[~taken[old]], new[taken[new]]))
    both = np.concatenate((times[~taken[old]], new_times[taken[new]]))
    return np.where(taken, new_tables, tables), both[np.argsort(dish, kind="stable")]


class Settings:
    """What all buckets share: number of tokens and types, discounts of contexts and of the parent, and the base distribution."""

    def __init__(self, tokens: int, types: int, discount: float, root: float = 0.5):
        self.tokens, self.types, self.discount, self.root = tokens, types, discount, root
        self.unknown = UNKNOWN if types else 1.0
        self.known = (1 - self.unknown) / types if types else 0.0

    def escape(self, totals: tuple[int, int]) -> float:
        """The parent's weight of the base distribution; totals: its customers and tables."""
        return (STRENGTH + self.root * totals[1]) / (STRENGTH + totals[0])

    def parent(self, customers: np.ndarray, tables: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
        """Probabilities of known words in the parent."""
        return (customers - self.root * tables) / (STRENGTH + totals[0]) + self.escape(totals) * self.known


# --- sweeps --------------------------------------------------------------------------------------------


def _add(values: np.ndarray, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of values for each of the ids (sorted, distinct)."""
    return np.bincount(np.searchsorted(ids, of), weights=values, minlength=len(ids)).astype(np.int64)


def _messages(bucket: int, ids: np.ndarray, buckets: int, **columns: np.ndarray) -> Iterator[dict]:
    """One message to each bucket of words; ids are sorted by that bucket, then rank."""
    part = ids % buckets
    starts = _starts(part)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)] if len(ids) else [], strict=True):
        yield {"bucket": bucket, "part": int(part[a]), "ranks": packed(np.diff(ids[a:b] // buckets, prepend=0)), **{k: packed(v[a:b]) for k, v in columns.items()}}


def _asked(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """The words of open pairs, ordered by bucket of words, then rank."""
    ids = np.unique(np.concatenate((u, w)))
    return ids[np.argsort(ids % buckets, kind="stable")]


def _open(buckets: int):
    """The open pairs of a bucket, one table each, and for every word the contexts it stands behind and the words behind it."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (u, w), counts = unpack_pairs(row), unpacked(row["counts"])
                many = counts > 1
                ids = np.unique(np.concatenate((u, w)))
                behind, ahead = _add(np.ones(len(w)), ids, w), _add(np.ones(len(u)), ids, u)
                asked = np.isin(ids, np.concatenate((u[many], w[many]))).astype(np.int64)
                order = np.argsort(ids % buckets, kind="stable")
                ones, none = np.ones(int(many.sum()), dtype=np.int64), np.zeros(0, dtype=np.int64)
                yield _rows(SEATED, [{"bucket": row["bucket"], "part": -1, **pack_pairs(u[many], w[many]), "counts": packed(counts[many]), "tables": packed(ones), "times": packed(none), "sums": packed(ones * 0)}])
                for message in _messages(row["bucket"], ids[order], buckets, customers=behind[order], seats=ahead[order], asked=asked[order]):
                    yield _rows(SEATED, [message])

    return start


def _words(settings: Settings, number: int, totals: tuple[int, int]):
    """A bucket of words takes the tables of all buckets of pairs, reseats the parent, and answers."""

    def step(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, parts = key[0].as_py(), sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["sender"]))
        state, messages = parts[0], parts[1:]
        counts = unpacked(state["counts"])
        ranks = [np.cumsum(unpacked(m["ranks"])) for m in messages]
        got = {k: np.zeros(len(counts), dtype=np.int64) for k in ("customers", "seats")}
        for m, r in zip(messages, ranks, strict=True):
            for k, total in got.items():
                total[r] += unpacked(m[k])
        if number == 0:
            behind, ahead, customers, seats = got["customers"], got["seats"], got["customers"], got["seats"]
            tables, times = np.minimum(customers, 1), np.zeros(0, dtype=np.int64)
        else:
            behind, ahead = unpacked(state["behind"]), unpacked(state["ahead"])
            customers, seats = behind + got["customers"], ahead + got["seats"]
            tables, times = cut_seating(customers, unpacked(state["tables"]), unpacked(state["times"]))
            rng = np.random.default_rng([number, bucket, 1])
            tables, times = reseat(customers, tables, times, STRENGTH + settings.root * (totals[1] - tables), settings.root, np.full(len(tables), settings.known), rng, number == 1)
        held = {"counts": counts, "behind": behind, "ahead": ahead, "customers": customers, "seats": seats, "tables": tables, "times": times}
        numbers = {"all_customers": int(customers.sum()), "all_tables": int(tables.sum()), "once": int((customers == 1).sum()), "twice": int((customers == 2).sum())}
        out = [{"bucket": bucket, "part": -1, **{k: packed(v) for k, v in held.items()}, **numbers}]
        for m, r in zip(messages, ranks, strict=True):
            r = r[unpacked(m["asked"]) > 0] if m["asked"] is not None else r
            if len(r):
                out.append({"bucket": bucket, "part": m["sender"], "customers": packed(customers[r]), "seats": packed(seats[r]), "tables": packed(tables[r])})
        return _table(PARENTS, out)

    return step


def _seat(settings: Settings, number: int, buckets: int, totals: tuple[int, int]):
    """A bucket of pairs reseats its open pairs, given the answers of the buckets of words, and sends its tables."""

    def step(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, parts = key[0].as_py(), sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["sender"]))
        state, answers = parts[0], parts[1:]
        (u, w), counts = unpack_pairs(state), unpacked(state["counts"])
        tables, times, sums = unpacked(state["tables"]), unpacked(state["times"]), unpacked(state["sums"])
        asked = _asked(u, w, buckets)
        order = np.argsort(asked, kind="stable")
        ids = asked[order]
        if len(u):
            customers, seats, above = (np.concatenate([unpacked(a[k]) for a in answers])[order] for k in ("customers", "seats", "above"))
            chance = settings.parent(customers, above, totals)[np.searchsorted(ids, w)]
            other = STRENGTH + settings.discount * (seats[np.searchsorted(ids, u)] - tables)
            tables, times = reseat(counts, tables, times, other, settings.discount, chance, np.random.default_rng([number, bucket, 0]), number == 1)
        if number > SWEEPS - KEPT:
            sums = sums + tables
        kept = {k: state[k] for k in ("us", "spread", "ws", "counts")}
        out = [{"bucket": bucket, "part": -1, **kept, "tables": packed(tables), "times": packed(times), "sums": packed(sums)}]
        more = {"customers": _add(tables - 1, ids, w), "seats": _add(tables - 1, ids, u)}
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return _table(SEATED, out + list(_messages(bucket, asked, buckets, **{k: v[back] for k, v in more.items()})))

    return step


def _gathered(state: DataFrame, messages: DataFrame, columns: list[str], others: dict[str, str]) -> DataFrame:
    """States (by bucket) with the messages that go to their bucket; kind 0 and 1."""
    binary = lambda name: F.lit(None).cast("binary").alias(name)
    mine = state.where("part = -1").select("bucket", F.lit(0).alias("kind"), F.lit(-1).alias("sender"), *columns, *[binary(k) for k in others])
    theirs = messages.where("part >= 0").select(F.col("part").alias("bucket"), F.lit(1).alias("kind"), F.col("bucket").alias("sender"), *[F.col(others[k]).alias(k) if k in others else binary(k) for k in [*columns, *others]])
    return mine.unionByName(theirs).groupBy("bucket")


# --- scores --------------------------------------------------------------------------------------------


def _pair_answers(key: tuple, rows: pa.Table) -> pa.Table:
    """For each chunk's pairs of a bucket: training counts and tables, summed over the kept sweeps."""
    parts = sorted(rows.to_pylist(), key=lambda r: r["chunk"])
    whole, (state, *lists) = next(r for r in parts if r["chunk"] == -2), [r for r in parts if r["chunk"] != -2]
    (u, w), counts = unpack_pairs(whole), unpacked(whole["counts"])
    sums = np.where(counts > 0, KEPT, 0)
    sums[counts > 1] = unpacked(state["sums"])
    first, at = np.unique(u, return_index=True)
    edges, out = np.append(at, len(u)), []
    top = int(w.max(initial=0)) + 1
    place = np.repeat(np.arange(len(first)), np.diff(edges)) * top + w  # ascends: contexts by number, then words
    for r in lists:
        x, y = unpack_pairs(r)
        context = np.minimum(np.searchsorted(first, x), len(first) - 1)
        wanted = context * top + y
        found = np.minimum(np.searchsorted(place, wanted), max(0, len(place) - 1))
        hit = (place[found] == wanted) & (first[context] == x) & (y < top) if len(place) else np.zeros(len(x), dtype=bool)
        n, s = (np.where(hit, v[found], 0) if len(place) else np.zeros(len(x), dtype=np.int64) for v in (counts, sums))
        out.append({"chunk": r["chunk"], "bucket": key[0].as_py(), "kind": 2, "counts": packed(n), "sums": packed(s)})
    return _table(ANSWERS, out)


def _word_answers(key: tuple, rows: pa.Table) -> pa.Table:
    """For each chunk's words of a bucket: customers and tables of the parent, and tables of the word's own restaurant, of one kept sweep."""
    parts = sorted(rows.to_pylist(), key=lambda r: r["chunk"])
    held, out = {k: unpacked(parts[0][k]) for k in ("customers", "seats", "tables")}, []
    for r in parts[1:]:
        ids = unpacked(r["ids"])
        rank = (ids[ids > 0] - 1) // r["buckets"]
        out.append({"chunk": r["chunk"], "bucket": key[0].as_py(), "kind": parts[0]["sweep"], **{k: packed(v[rank]) for k, v in held.items()}})
    return _table(ANSWERS, out)


def _score(settings: Settings, buckets: int, totals: dict[int, tuple[int, int]]):
    def score(key: tuple, rows: pa.Table) -> pa.Table:
        pairs = _Pairs(rows, buckets)
        known, s = pairs.ids >= 0, settings
        own = np.zeros(len(pairs.context))
        if len(pairs.known):
            found = [r for r in pairs.others if r["kind"] == 2]
            n, tables = (np.concatenate([unpacked(r[k]) for r in found]) for k in ("pair_counts", "sums"))
            own[pairs.known] = n - s.discount * tables / KEPT
        size = STRENGTH + pairs.counts
        chance = own / size[pairs.context]
        for sweep, total in totals.items():
            found = [r for r in pairs.others if r["kind"] == sweep]
            held = {k: np.zeros(len(pairs.ids), dtype=np.int64) for k in ("customers", "seats", "tables")}
            for k, v in held.items():
                v[known] = np.concatenate([unpacked(r[k]) for r in found]) if found else 0
            parent = np.where(known, s.parent(held["customers"], held["tables"], total), s.escape(total) * s.unknown)
            weight = (STRENGTH + s.discount * held["seats"]) / size
            chance += weight[pairs.context] * parent[pairs.word] / len(totals)
        logs, counts = np.log10(chance), pairs.counts[pairs.word]
        base = np.log10((counts + 0.5) / (s.tokens + 0.5 * (s.types + 1)))
        missing = unpacked(pairs.facts["missing"]).astype(bool)
        add = lambda by_pair: np.add.reduceat(by_pair[pairs.place], pairs.first)
        columns = [
            pa.array(np.frombuffer(pairs.facts["doc_ids"], dtype="<i8"), mask=missing),
            pa.array(unpacked(pairs.facts["held"]).astype(bool), mask=missing),
            pa.array(pairs.sizes),
            pa.array(add((counts > 0).astype(np.int64))),
            pa.array(np.full(len(pairs.sizes), s.tokens, dtype=np.int64)),
            pa.array(add(base)),
            pa.array(add(logs)),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")])

    return score


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def score_documents(docs: DataFrame, held_out_part: int = 1, parts: int = 5) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) modulo parts is not held_out_part.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams), score
    (log10 probability by the Pitman-Yor model; perplexity is 10 ** (-score / n_tokens)).
    """
    spark, part = docs.sparkSession, fold(parts=parts)
    binary = lambda *names: [F.lit(None).cast("binary").alias(k) for k in names]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part == held_out_part, F.lit(False)).alias("held"), F.coalesce(part != held_out_part, F.lit(False)).alias("learn"), text_or_empty().alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    buckets = max(partitions(spark), size // BUCKET_BYTES)
    chunks = stored(rows.mapInArrow(_split(buckets), CHUNKS))
    named = stored(chunks.where("bucket >= 0").select("bucket", "chunk", "words", "counts").groupBy("bucket").applyInArrow(_name(buckets), NAMED))
    facts = ["doc_ids", "missing", "held", "learn", "sizes", "tokens"]
    texts = chunks.where("bucket = -1").select("chunk", "bucket", *facts, *binary("ids", "counts"))
    names = named.where("chunk >= 0").select("chunk", "bucket", *binary(*facts), "ids", "counts")
    lists = stored(texts.unionByName(names).groupBy("chunk").applyInArrow(_lists(buckets), LISTS))
    pairs = stored(lists.groupBy("bucket").applyInArrow(_merge, PAIRS))
    release_shuffles(spark)
    n = named.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    m = pairs.agg(F.coalesce(F.sum("once"), F.lit(0)).alias("once"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice")).first()
    settings = Settings(n["tokens"], n["types"], _discount(m["once"], m["twice"]))
    held = ["counts", "behind", "ahead", "tables", "times"]
    word_state = named.where("chunk = -1").select("bucket", F.lit(-1).alias("part"), "counts", *binary(*held[1:]))
    pair_state, kept, totals = stored(pairs.mapInArrow(_open(buckets), SEATED)), {}, (0, 0)
    for number in range(SWEEPS + 1):
        if number:
            before = pair_state
            answers = {"customers": "customers", "seats": "seats", "above": "tables"}
            pair_state = stored(_gathered(before, word_state, ["us", "spread", "ws", "counts", "tables", "times", "sums"], answers).applyInArrow(_seat(settings, number, buckets, totals), SEATED))
            drop_stored(before)
        before = word_state
        told = {"ranks": "ranks", "customers": "customers", "seats": "seats", "asked": "asked"}
        word_state = stored(_gathered(before, pair_state, held, told).applyInArrow(_words(settings, number, totals), PARENTS))
        if number and number - 1 not in kept:
            drop_stored(before)
        t = word_state.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("all_customers", "all_tables", "once", "twice")]).first()
        totals = t["all_customers"], t["all_tables"]
        if number == 0:
            settings.root = _discount(t["once"], t["twice"])
        release_shuffles(spark)
        if number > SWEEPS - KEPT:
            kept[number] = word_state, totals
    columns = ["kind", "pair_counts", "sums", "customers", "seats", "tables"]
    wanted = lists.select("bucket", "chunk", "us", "spread", "ws", "counts", *binary("sums"))
    seated = pairs.select("bucket", F.lit(-2).cast("long").alias("chunk"), "us", "spread", "ws", "counts", *binary("sums"))
    summed = pair_state.where("part = -1").select("bucket", F.lit(-1).cast("long").alias("chunk"), *binary("us", "spread", "ws", "counts"), "sums")
    replies = stored(wanted.unionByName(seated).unionByName(summed).groupBy("bucket").applyInArrow(_pair_answers, ANSWERS))
    for table in (lists, pairs, pair_state):
        drop_stored(table)
    release_shuffles(spark)
    found = [replies]
    for sweep, (state, _) in kept.items():
        asks = named.where("chunk >= 0").select("bucket", "chunk", "ids", F.lit(buckets).alias("buckets"), F.lit(0).alias("sweep"), *binary("customers", "seats", "tables"))
        states = state.where("part = -1").select("bucket", F.lit(-1).cast("long").alias("chunk"), *binary("ids"), F.lit(buckets).alias("buckets"), F.lit(10 + sweep).alias("sweep"), "customers", "seats", "tables")
        found.append(asks.unionByName(states).groupBy("bucket").applyInArrow(_word_answers, ANSWERS))
    gathered = texts.unionByName(names).select("*", F.lit(0).alias("kind"), *binary(*columns[1:]))
    for table in found:
        gathered = gathered.unionByName(table.select("chunk", "bucket", *binary(*facts, "ids"), F.col("counts").alias("pair_counts"), "kind", "sums", "customers", "seats", "tables"), allowMissingColumns=True)
    return gathered.groupBy("chunk").applyInArrow(_score(settings, buckets, {10 + k: total for k, (_, total) in kept.items()}), SCORES)
