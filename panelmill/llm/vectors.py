"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the ordered list of its PREFIX nearest reference points (pivots). Inverted
lists lead from a pivot to the vectors that have it in their prefix. Vectors of a label that share at
least SHARED pivots are candidates, and their cosine is computed in double precision. Equal vectors
are one node with a count, so groups of copies are never expanded into pairs; a list longer than
BLOCK is dealt over pairs of blocks. A pair that shares several lists counts in the one of its least
common pivot. Tasks return sums and local roots, never pairs.

The pivots are a sample of 2 sqrt(n) out of n vectors of a length (the first of twice as many by a seeded hash,
none within a cosine of 0.9 of another; LEAST_PIVOTS at least), so an inverted list grows with the square root, too;
for 10**9 vectors of 64 numbers that is 32 MB. Every vector is indexed.

Defined results: null labels, null, empty or zero vectors and those with null or non-finite
components link with nothing and stand alone; vectors of different lengths do not link; rows with an
equal vec_id are judged each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import stored
from panelmill.llm.components import connected

COSINE = 0.98
PREFIX, SHARED, BLOCK = 10, 3, 1024
LEAST_PIVOTS = 64
LINKS = "node long, links long, root long"


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def prefixes(units: np.ndarray, pivots: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first."""
    near = units @ pivots.T
    length = min(length, near.shape[1])
    part = np.argpartition(-near, length - 1, axis=1)[:, :length]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def _describe(shipped: Broadcast):
    def describe(batches):
        pivots = shipped.value
        for batch in batches:
            out = []
            width = batch.column("width").to_numpy()
            for w in np.unique(width):
                rows = batch.filter(pa.array(width == w))
                near = prefixes(unit_rows(rows.column("embedding"), int(w)), pivots[int(w)])
                columns = [*(rows.column(k) for k in ("node", "label", "width", "copies", "embedding")), pa.array(list(near), pa.list_(pa.int32()))]
                out.append(pa.RecordBatch.from_arrays(columns, ["node", "label", "width", "copies", "embedding", "prefix"]))
            yield from out

    return describe


def _holds(prefix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Which of some pivots (sorted) each prefix holds, as 0 and 1."""
    at = np.minimum(np.searchsorted(pivots, prefix), len(pivots) - 1)
    row, column = np.nonzero(pivots[at] == prefix)
    out = np.zeros((len(prefix), len(pivots)), dtype=np.float32)
    out[row, at[row, column]] = 1
    return out


def _least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least pivot that both of two prefixes hold, row by row."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(same, a, np.iinfo(np.int32).max).min(axis=1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return root


def _links_in(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of links and local roots within one block, or between two blocks, of one inverted list."""
    pivot, width, left, right = (k.as_py() for k in key[1:])
    table = rows.combine_chunks().sort_by("node")
    node, side, copies = (table.column(k).to_numpy() for k in ("node", "block", "copies"))
    units = unit_rows(table.column("embedding").combine_chunks(), width)
    prefix = np.array(table.column("prefix").combine_chunks().flatten()).reshape(len(node), -1).astype(np.int32)
    a, b = np.flatnonzero(side == left), np.flatnonzero(side == right)
    links, pairs_i, pairs_j = np.zeros(len(node), dtype=np.int64), [], []
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        # First the pivots that two prefixes share; then the cosines of the rows and columns that have such a pair.
        own = np.unique(prefix[part])
        near = _holds(prefix[part], own) @ _holds(prefix[b], own).T >= min(SHARED, prefix.shape[1])
        row, column = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near[np.ix_(row, column)] &= units[part[row]] @ units[b[column]].T >= COSINE
        if left == right:
            near &= b[None, :] > part[:, None]
        i, j = np.nonzero(near)
        i, j = part[i], b[j]
        for cut in range(0, len(i), 1 << 16):
            x, y = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            mine = _least_shared(prefix[x], prefix[y]) == pivot
            pairs_i.append(x[mine])
            pairs_j.append(y[mine])
    i, j = (np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in (pairs_i, pairs_j))
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    found = links > 0
    return pa.table({"node": node[found], "links": links[found], "root": node[_roots(len(node), i, j)][found]})


def choose_pivots(nodes: DataFrame, seed: int = 3) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors. Of n vectors of a length, 4 sqrt(n) come to the driver."""
    out = {}
    for width, n in nodes.groupBy("width").count().collect():
        number = int(max(LEAST_PIVOTS, 2 * np.sqrt(n)))
        rows = nodes.where(F.col("width") == width).orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(2 * number).select("embedding").toArrow()
        out[width] = apart(unit_rows(rows.column("embedding").combine_chunks(), width))[:number]
    return out


def apart(units: np.ndarray, most: float = 0.9) -> np.ndarray:
    """The rows that no earlier kept row is nearer to than a cosine. Pivots within a group of near copies
    would order themselves differently for each of its vectors."""
    kept = np.empty_like(units)
    n = 0
    for row in units:
        if not n or (kept[:n] @ row).max() < most:
            kept[n] = row
            n += 1
    return kept[:n]


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding").withColumn("sound", F.coalesce(sound, F.lit(False)))
    # Equal rows that can link are one node, found by a digest of 128 bits; each of the others stands alone.
    rows = rows.withColumns({"h1": F.when(F.col("sound"), F.xxhash64("label", "embedding")), "h2": F.when(F.col("sound"), F.xxhash64(F.lit(1), "label", "embedding"))})
    nodes = stored(rows.where("sound").groupBy("h1", "h2", "label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")).withColumns({"width": F.size("embedding"), "node": F.monotonically_increasing_id()}))
    pivots = choose_pivots(nodes)
    described = nodes.select("node", "label", "width", "copies", "embedding").mapInArrow(_describe(vectors.sparkSession.sparkContext.broadcast(pivots)), "node long, label int, width int, copies long, embedding array<float>, prefix array<int>")
    described = stored(described)
    posted = described.withColumn("pivot", F.explode("prefix"))
    sizes = posted.groupBy("label", "width", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    posted = posted.join(F.broadcast(sizes) if _few(sizes) else sizes, ["label", "width", "pivot"])
    posted = posted.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks").cast("long")).cast("int"))
    # Every row meets its own block and, for long lists, each other block once.
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    posted = posted.withColumn("other", F.explode(other))
    posted = posted.select("label", "pivot", "width", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "copies", "embedding", "prefix")
    found = stored(posted.groupBy("label", "pivot", "width", "left", "right").applyInArrow(_links_in, LINKS))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "h1", "h2", "copies", "least_id").join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(stored(named), "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # Written tables on both sides let Spark split the rows of a frequent vector.
    linked = rows.where("sound").select("vec_id", "h1", "h2").join(stored(known), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _few(sizes: DataFrame, most: int = 200_000) -> bool:
    """Whether the list sizes are few enough to broadcast; counted, and joined by shuffle beyond that."""
    return sizes.limit(most + 1).count() <= most
