"""Near duplicates by Order MinHash, verified by banded alignment.

Words are runs of letters and digits of the lower-cased text. A k-mer is a run of five words,
labelled with its occurrence number in the text. A sketch holds the k-mers with the LEAST least values
of one hash function, in text order; two texts agree in a sketch with about the probability J**LEAST, less
where the order differs, so agreement follows edit similarity rather than set overlap. Texts that
agree in any of the SKETCHES sketches are candidates. One edit can break all k-mers of a short text. So texts of up
to SHORT words, and those long enough to be similar to one, are sketched by single words instead: of n
occurrence-labelled words similar texts have all but a fifth in common, so the SHARED least common ones are
among the n / 5 + SHARED least of either, and each choice of SHARED from those is a key. No link of such texts is missed.

A candidate pair is verified by aligning its words: with LCS the length of the longest common subsequence,
similarity = LCS / (n1 + n2 - LCS), and 0.8 or more is a link. At most a ninth of both lengths is then
inserted or deleted, so a band of that width around the diagonal is enough; the alignment runs
bit-parallel inside the band. (A word changed in five k-mers counts once. Whatever reaches 0.8 by
aligned k-mers does so by words.) A class is a connected set of links.

Copies of a text (equal words, by a digest of 128 bits) are one node, so groups of copies are never
expanded into pairs. In a bucket of candidates every node is first aligned with a leader, the node whose
sketches are most common, rather than with every other one. Where a bucket still spans several components,
the nodes outside its largest component are compared with all nodes of the bucket, in blocks and without a
cap: a matrix product of folded word counts, which is never below the number of shared words, rules pairs
out, and the alignment decides on the others.

Defined results: a null text is empty; texts without words are copies only if their characters are
equal; a text below five words is one k-mer; rows with equal doc_id are judged each by itself; a
class is named by its least doc_id (null if all are null); an empty table gives an empty result; other
columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelmill.llm.common import release_shuffles, stored
from panelmill.llm.components import connected
from panelmill.llm.words import U64, hashed_words, mix, shingles, string_parts

KMER, SIMILARITY = 5, 0.8
SKETCHES, LEAST = 24, 3
#: Up to so many words, candidates are found by single words alone; partners of such texts have at most SHORT / SIMILARITY.
SHORT = 24
#: Words in a key of a short text. Similar texts that aren't equal have at least four in common.
SHARED = 4
#: Nodes of a bucket on either side of one comparison, and numbers in one matrix of it.
BLOCK, TILE = 1024, 1 << 20
SKETCHED = "key binary, kmers int, words binary, sketches array<long>"
_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(0, 2**63, SKETCHES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SHIFT = _RNG.integers(0, 2**63, SKETCHES, dtype=np.int64).astype(U64)


def label_occurrences(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer's hash combined with how often it occurred before in the text."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if first.all():
        return kmers
    run = np.flatnonzero(first)
    seen = np.arange(len(kmers)) - np.repeat(run, np.diff(np.append(run, len(kmers))))
    out = np.empty_like(kmers)
    out[order] = np.where(seen > 0, mix(ranked + seen.astype(U64) * U64(0x9E3779B97F4A7C15)), ranked)
    return out


def sketch(kmers: np.ndarray) -> np.ndarray:
    """M sketches of a text's k-mers."""
    labelled = label_occurrences(kmers)
    n, out = len(labelled), np.empty(SKETCHES, dtype=U64)
    step = max(1, (1 << 20) // n)
    for at in range(0, SKETCHES, step):
        odd, shift = _ODD[at : at + step, None], _SHIFT[at : at + step, None]
        values = (labelled[None, :] ^ shift) * odd
        values ^= values >> U64(29)
        values *= odd
        if n > LEAST:
            chosen = np.sort(np.argpartition(values, LEAST - 1, axis=1)[:, :LEAST], axis=1)
        else:
            chosen = np.broadcast_to(np.arange(n), (len(odd), n))
        total = np.arange(at, at + len(odd)).astype(U64)
        for i in range(chosen.shape[1]):
            total = mix(total * U64(0x9E3779B97F4A7C15) + labelled[chosen[:, i]])
        out[at : at + len(odd)] = total
    return out


@functools.cache
def _choices(n: int) -> np.ndarray:
    """All ways to choose SHARED of n places, one a row: at most 210, as a short text has at most 10 places."""
    return np.array(list(itertools.combinations(range(n), SHARED)), dtype=np.int64).reshape(-1, SHARED)


def short_keys(words: np.ndarray) -> np.ndarray:
    """Keys of which two texts of similarity 0.8 or more share at least one; none below SHARED words, where only copies are similar."""
    labelled = label_occurrences(words)
    least = labelled[np.argsort(mix(labelled ^ U64(SHORT)), kind="stable")[: int(len(words) * (1 - SIMILARITY) + 1e-9) + SHARED]]
    total = np.full(len(_choices(len(least))), SHORT, dtype=U64)
    for word in least[_choices(len(least))].T:
        total = mix(total * U64(0x9E3779B97F4A7C15) + word)
    return total


def bucket_keys(words: np.ndarray, kmers: np.ndarray) -> np.ndarray:
    """What candidates share at least one of: keys of single words of short texts, sketches of others, both in between."""
    every = [short_keys(words)] if len(words) * SIMILARITY <= SHORT else []
    return np.concatenate(every + ([sketch(kmers)] if len(words) > SHORT else []))


def sketched(texts: pd.Series) -> pd.DataFrame:
    """Content key, number of k-mers, word hashes (32 bits each) and keys of buckets of each text."""
    keys, sizes, words_out, sketches = [], [], [], []
    for at in range(0, len(texts), 512):
        part = pa.array([t or "" for t in texts.iloc[at : at + 512]], pa.string())
        raw = part.to_pylist()
        offsets, data = string_parts(pc.utf8_lower(part))
        for a, _, counts, words in hashed_words(offsets, data, white_space_only=False):
            words = words & U64(0xFFFFFFFF)
            runs, number = shingles(words, counts, KMER)
            word_at, run_at = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(number)))
            for i in range(len(counts)):
                mine, kmers = words[word_at[i] : word_at[i + 1]], runs[run_at[i] : run_at[i + 1]]
                own = mine.astype("<u4").tobytes()
                content = own or b"\0" + raw[a + i].encode()
                keys.append(hashlib.blake2b(content, digest_size=16).digest())
                sizes.append(len(kmers))
                words_out.append(own)
                sketches.append(bucket_keys(mine, kmers).view(np.int64) if len(kmers) else np.zeros(0, dtype=np.int64))
    return pd.DataFrame({"key": keys, "kmers": np.array(sizes, dtype=np.int32), "words": words_out, "sketches": sketches}, index=texts.index)


def banded_lcs(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within a band of diagonals, bit-parallel.

    Bit i of the window is 0 where the length grows at x[i]. Bits that fall out of the band are
    settled; the result is the true length whenever a longest one keeps within the band, and never more.
    """
    places: dict[int, list[int]] = {}
    for i, v in enumerate(x.tolist()):
        places.setdefault(v, []).append(i)
    low, high, window, settled = 0, 0, 0, 0
    for j, v in enumerate(y.tolist()):
        to = min(len(x), j + band + 1)
        if to > high:
            window |= ((1 << (to - high)) - 1) << (high - low)
            high = to
        while low < j - band and low < high:
            settled += 1 - (window & 1)
            window >>= 1
            low += 1
        mask = 0
        for p in places.get(v, ()):
            if low <= p < high:
                mask |= 1 << (p - low)
        if mask:
            hit = window & mask
            window = ((window + hit) | (window - hit)) & ((1 << (high - low)) - 1)
    return settled + (high - low) - window.bit_count()


def similar(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether LCS / (n1 + n2 - LCS) of two sequences is at least the similarity."""
    total = len(x) + len(y)
    need = int(np.ceil(least / (1 + least) * total - 1e-9))
    if min(len(x), len(y)) < need:
        return False
    short = min(len(x), len(y))
    differs = np.flatnonzero(x[:short] != y[:short])
    head = int(differs[0]) if len(differs) else short
    x, y, short = x[head:], y[head:], short - head
    differs = np.flatnonzero(x[len(x) - short :][::-1] != y[len(y) - short :][::-1])
    tail = int(differs[0]) if len(differs) else short
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if head + tail >= need:
        return True
    values, counts = np.unique(x, return_counts=True)
    others, more = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    if head + tail + int(np.minimum(counts[i], more[j]).sum()) < need:
        return False
    return head + tail + banded_lcs(x, y, total - 2 * need) >= need


def _kmers(words: bytes) -> np.ndarray:
    own = np.frombuffer(words, dtype="<u4").astype(U64)
    return shingles(own, np.array([len(own)]), KMER)[0]


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4").astype(U64)


def _verify(batches):
    for batch in batches:
        a, b = batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist()
        ok = pa.array([similar(_words(x), _words(y)) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(ok)


def _of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with a key among those given, by a merge join whatever the sizes, so that plans at all sizes are alike."""
    return rows.join(keys.select("key").distinct().hint("merge"), "key", "left_semi")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The links (a, b) among candidate pairs; rows: key, words."""
    texts = stored(_of(rows.select("key", "words"), pairs.select(F.explode(F.array("a", "b")).alias("key"))))
    left, right = (texts.select(F.col("key").alias(k), F.col("words").alias(f"words_{k}")) for k in "ab")
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b").mapInArrow(_verify, "a long, b long"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_classes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, root) for texts that have near duplicates; rows: key (the row's number), words, sketches; nodes: the keys of one row a text."""
    buckets = _of(rows.select("key", "sketches"), nodes).select("key", F.explode("sketches").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(buckets.join(sizes, "bucket"))
    common = shared.groupBy("key").agg(F.sum("members").alias("common"))
    leader = shared.join(common, "key").groupBy("bucket").agg(F.max(F.struct("common", "key"))["key"].alias("leader"))
    led = shared.join(leader, "bucket").where(F.col("key") != F.col("leader")).select(*_ordered("key", "leader")).distinct()
    links = verified(stored(led), rows)
    release_shuffles(rows.sparkSession)
    more = open_links(shared, connected(links), rows)
    return connected(links.unionByName(more)).withColumnRenamed("node", "key")


def open_links(shared: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that the leaders left out: in each bucket that still spans components, the nodes outside
    its largest component are compared with all of its nodes, in blocks.

    Tasks return links only, so no pair of texts is ever a row.
    """
    placed = shared.select("bucket", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    whole = whole.select("bucket", F.col("top.root").alias("largest"), blocks(F.col("members")).alias("member_blocks"), blocks(F.col("members") - F.col("top.n")).alias("probe_blocks"))
    rows = stored(placed.join(whole, "bucket"))
    rows = rows.join(_of(texts.select("key", "words"), rows).hint("merge"), "key")
    own = lambda n: F.pmod(F.xxhash64(F.lit(2), "key"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = rows.select("bucket", every(F.col("probe_blocks")).alias("p"), own(F.col("member_blocks")).alias("m"), F.lit(False).alias("probe"), "key", "root", "words")
    probes = rows.where(F.col("root") != F.col("largest")).select("bucket", own(F.col("probe_blocks")).alias("p"), every(F.col("member_blocks")).alias("m"), F.lit(True).alias("probe"), "key", "root", "words")
    return stored(members.unionByName(probes).groupBy("bucket", "p", "m").applyInArrow(_block_links, "a long, b long"))


def _folded(texts: list[np.ndarray], width: int) -> np.ndarray:
    """Counts of words by hash bin, a word's n-th occurrence in a bin of its own. The product of two rows is never less than the words they share."""
    row = np.repeat(np.arange(len(texts)), [len(k) for k in texts])
    bins = np.concatenate([mix(label_occurrences(t)) for t in texts]) & U64(width - 1)
    return np.bincount(row * width + bins.astype(np.int64), minlength=len(texts) * width).reshape(len(texts), width).astype(np.float32)


def _block_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the probes and the members of a block that join different components."""
    table = rows.combine_chunks().sort_by("key")
    keys, roots, probe = (table.column(k).to_numpy(zero_copy_only=False) for k in ("key", "root", "probe"))
    texts = [_words(w) for w in table.column("words").to_pylist()]
    sizes = np.array([len(k) for k in texts])
    width = 1 << int(16 * sizes.max()).bit_length()
    tile = max(1, TILE // width)
    parent = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    left, right, links = np.flatnonzero(probe), np.flatnonzero(~probe), []
    for at in range(0, len(left), tile):
        mine = left[at : at + tile]
        folded = _folded([texts[i] for i in mine], width)
        for to in range(0, len(right), tile):
            theirs = right[to : to + tile]
            need = np.ceil(SIMILARITY / (1 + SIMILARITY) * (sizes[mine][:, None] + sizes[theirs][None, :]) - 1e-9)
            fits = (folded @ _folded([texts[i] for i in theirs], width).T >= need) & (np.minimum(sizes[mine][:, None], sizes[theirs][None, :]) >= need)
            for i, j in zip(*np.nonzero(fits & (roots[mine][:, None] != roots[theirs][None, :])), strict=True):
                i, j = mine[i], theirs[j]
                a, b = find(int(roots[i])), find(int(roots[j]))
                # Once two components are joined, their other pairs change no class.
                if a != b and similar(texts[i], texts[j]):
                    parent[a] = b
                    links.append((int(keys[i]), int(keys[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def classed(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The written table (row: a struct of the columns of docs, origin: the row's number, omh: its sketches), and
    one row for each distinct text: key, first (the least doc_id's row: n, d, o), root (equal for near duplicates), copies.

    Texts are read and sketched once. Copies are summed up before anything is joined, so a text that a third
    of all rows share is one row from there on.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    table = stored(docs.select(columns.alias("row"), F.monotonically_increasing_id().alias("origin"), pandas_udf(sketched, SKETCHED)(F.col(text)).alias("omh")))
    # Null keys sort behind all others, so a class is named by a key if any row has one.
    doc = F.col("row.doc_id").cast("long")
    order = F.struct(doc.isNull().alias("n"), doc.alias("d"), F.col("origin").alias("o"))
    texts = stored(table.groupBy(F.col("omh.key").alias("key")).agg(F.min("origin").alias("node"), F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")))
    rows = table.select(F.col("origin").alias("key"), "omh.words", "omh.sketches")
    roots = near_classes(rows, texts.select(F.col("node").alias("key"))).select(F.col("key").alias("node"), "root")
    release_shuffles(docs.sparkSession)
    return table, texts.join(roots, "node", "left").select("key", "first", "copies", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, kept (true for one row of each class)."""
    table, texts = classed(docs.select("doc_id", "text"))
    texts = stored(texts)
    # Written tables on both sides of each join let Spark split the rows of a large class or of a frequent text.
    classes = stored(texts.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size")))
    named = stored(texts.select("key", "root").join(classes, "root").select("key", "first", "class_size"))
    rows = table.select(F.col("row.doc_id").cast("long").alias("doc_id"), "origin", F.col("omh.key").alias("key"))
    return rows.join(named, "key").select("doc_id", F.col("first.d").alias("class_id"), "class_size", (F.col("first.o") == F.col("origin")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, with one row of each class of near duplicates (the least doc_id, then the first row)."""
    table, texts = classed(docs)
    first = stored(texts.groupBy("root").agg(F.min("first")["o"].alias("origin")).select("origin"))
    return table.select("row", "origin").join(first.hint("merge"), "origin", "left_semi").select("row.*")
