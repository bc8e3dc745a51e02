"""Sharding by a two-pass external shuffle.

Pass 1 scatters records by seeded hashes. The document key alone picks the shard (rendezvous
hashing: the shard whose hash with the key is greatest), so one more shard takes records only into
itself. A second hash, of the record's place in the input, scatters the records of a shard uniformly
into buckets of a size that fits in memory; a key that many records share therefore never makes a
large bucket. Pass 2 shuffles each bucket by Fisher-Yates with a seed of its own and writes it. The
buckets of a shard follow one another, which gives each record its slot.

Defined results: a null text has no bytes; null keys share one shard; repeated rows keep one slot
each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import partitions, shared_dir

ROW_OVERHEAD = 16
SHARDED = "doc_id long, text string, shard int, bucket int, place long"


def shard_of(key: str, shards: int, seed: int) -> Column:
    """The shard with the greatest hash for the key (rendezvous hashing)."""
    scored = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), i, F.col(key)).alias("score"), i.alias("shard")))
    return F.array_max(scored)["shard"]


def _fisher_yates(seed: int, shard: int, bucket: int, rows: pa.Table) -> pa.Table:
    """One bucket, which arrives in a fixed order whatever the attempt, in its seeded order."""
    order = np.random.default_rng([seed, shard, bucket]).permutation(rows.num_rows)
    out = rows.take(pa.array(order)).select(["doc_id", "text", "shard", "bucket"])
    return out.append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))


def _shuffled(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            number = batch.column("shard").to_numpy().astype(np.int64) << 32 | batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)] if len(number) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if last is not None and number[a] != last:
                    yield from _fisher_yates(seed, last >> 32, last & 0xFFFFFFFF, pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
                last = int(number[a])
        if held:
            yield from _fisher_yates(seed, last >> 32, last & 0xFFFFFFFF, pa.Table.from_batches(held)).to_batches()

    return shuffle


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20240229, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Write the records under path as shard=S/ files in shuffled order and return them as read back.

    Columns: doc_id, text, shard, bucket, place (in the bucket). The number of buckets of a shard
    follows its bytes, which are counted first; only one number per shard reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("shard", shard_of("doc_id", shards, seed))
    sizes = rows.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).alias("bytes")).collect()
    buckets = {r["shard"]: max(1, -(-int(r["bytes"]) // bucket_bytes)) for r in sizes}
    count = F.element_at(F.array(*[F.lit(buckets.get(s, 1)) for s in range(shards)]), F.col("shard") + 1)
    rows = rows.withColumn("origin", F.monotonically_increasing_id())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "origin"), count.cast("long")).cast("int"))
    # Buckets are numbered through all shards and dealt to tasks in turn, so no two tasks differ by more than one bucket.
    first = F.element_at(F.array(*[F.lit(sum(buckets.get(t, 1) for t in range(s))) for s in range(shards)]), F.col("shard") + 1)
    total = sum(buckets.get(s, 1) for s in range(shards))
    tasks = max(partitions(spark), min(total, 20_000))
    dealt = rows.repartitionById(tasks, F.pmod(first + F.col("bucket"), F.lit(tasks)).cast("int"))
    ordered = dealt.sortWithinPartitions("shard", "bucket", "doc_id", "origin").mapInArrow(_shuffled(seed), SHARDED)
    ordered.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(SHARDED).parquet(path)


def with_slots(sharded: DataFrame) -> DataFrame:
    """Add slot: the record's place in its shard, gapless from 0.

    The join moves every column it is given, so drop or digest texts that are not needed first.
    """
    counts = sharded.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    return sharded.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("place")).drop("first")


def shard_records(docs: DataFrame, shards: int = 40, seed: int = 20240229, path: str | None = None) -> DataFrame:
    """Records with their shard and slot, read back from the shard files."""
    path = path or shared_dir(docs.sparkSession)
    return with_slots(write_shards(docs, path, shards, seed))
