"""Connected components of a link table by alternating star contraction, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step. edges: a > b, distinct. Large: each node sends its larger neighbours to
    its least one; small: its smaller neighbours and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        moved = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of the component.

    Each round is written to the shared folder. The number of rounds grows with the logarithm of the
    longest chain; only a count and a checksum come to the driver.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    now, before = stored(pairs.distinct()), None
    while (state := _state(now)) != before:
        after = stored(_star(_star(now, large=True), large=False))
        drop_stored(now)
        now, before = after, state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
