"""Daily bars, the benchmark and the session calendar, built from trades.

A trade is a line item; its part's brand is the instrument. Open and close are the first and last
trade of the session in a total order of the trades' own columns, so the bars do not depend on file
order. Trades are aggregated by (code, date) before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.sources.cuts import shared

PRICED = ["price", "quantity", "amount", "leading", "sequence"]
#: Up to so many instruments the ends of their sessions go to every task; with more, the planner decides.
FEW_CODES = 100
#: So many parts may go to every task, if the planner likes; more are dealt by their key, as their files tell little of the memory they need.
FEW_PARTS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, price, quantity, amount, the order key and the columns that order trades within a session."""
    return _lines(spark, sf_dir).join(_dealt(_parts(spark, sf_dir)), "l_partkey").select("code", "date", *PRICED)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_partkey",
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        # The leading column of the order; a null comes first.
        F.coalesce("l_orderkey", F.lit(-(2**63))).alias("leading"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("sequence"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"))


def _dealt(parts: DataFrame) -> DataFrame:
    """Many parts are hashed within the partitions of a shuffle by their key, so that a task holds its share of them and sorts no trades."""
    return parts.hint("shuffle_hash") if parts.count() > FEW_PARTS else parts


def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, high, low, volume, amount, trades and the range of the trades' leading key: numbers only, so they are hashed, not sorted."""
    return (
        trades(spark, sf_dir)
        .groupBy("code", "date")
        .agg(
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum("quantity").alias("volume"),
            F.round(F.sum("amount"), 6).alias("amount"),
            F.count(F.lit(1)).alias("trades"),
            F.min("leading").alias("from"),
            F.max("leading").alias("to"),
        )
    )


@shared
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, open, high, low, close, volume, amount, trades.

    An order by six columns would have Spark sort all trades before it aggregates them. So a session's totals and the range of
    its leading key come first; only the trades at both ends of that range, which hold the first and the last one, are compared in full.
    """
    totals, parts = session_totals(spark, sf_dir), _parts(spark, sf_dir)
    ends = totals.withColumn("leading", F.explode(F.array_distinct(F.array("from", "to")))).withColumnsRenamed({"date": "day", "leading": "end", "amount": "total"})
    if parts.select("code").distinct().limit(FEW_CODES + 1).count() <= FEW_CODES:
        ends = F.broadcast(ends)  # two rows a session of at most FEW_CODES instruments
    found = _lines(spark, sf_dir).select("l_partkey", "date", "price", "leading", "sequence")
    found = found.join(ends, (F.col("leading") == F.col("end")) & F.col("date").eqNullSafe(F.col("day")))
    found = found.join(_dealt(parts.withColumnRenamed("code", "brand")), "l_partkey").where(F.col("code").eqNullSafe(F.col("brand")))
    own = lambda c, name: F.first(c).alias(name)
    return found.groupBy("code", "date").agg(
        F.min_by("price", "sequence").alias("open"),
        own("high", "high"),
        own("low", "low"),
        F.max_by("price", "sequence").alias("close"),
        own("volume", "volume"),
        own("total", "amount"),
        own("trades", "trades"),
    )


def by_code() -> Window:
    return Window.partitionBy("code").orderBy("date")


def numbered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with n, the bar's number within its instrument, from 1."""
    return daily_bars(spark, sf_dir).withColumn("n", F.row_number().over(by_code()).cast("bigint"))


@shared
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, bench: the volume-weighted price of all trades of a session."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("bench"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays between the first and the last trade."""
    span = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    return days.where(F.weekday("date") < 5)


def aliased(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Standard columns from the first alias that the table has; other aliases are dropped."""
    have = set(df.columns)
    return df.select(*[F.coalesce(*[F.col(c) for c in names if c in have]).alias(to) for to, names in aliases.items() if have & set(names)])


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
