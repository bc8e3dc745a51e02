"""Shared folder, written tables and small column helpers for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    It lies in the folder that the session names in spark.checkpoint.dir. Only where that setting
    is empty (local tests) is a temporary folder of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="panelmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/panelmill-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder or file as Spark names it (file, hdfs, s3a, gs), and the path there."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it again; this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that stored() has written and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver has collected its garbage."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_partitions(df: DataFrame, size: int) -> int:
    """Partitions of about size bytes by Spark's own estimate of the table (as in explain("cost")), at least the shuffle partitions.

    Where Spark knows no size, the shuffle partitions are what is left.
    """
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(partitions(df.sparkSession), -(-estimate // size) if estimate < 1 << 60 else 0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(key: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the key's decimal text, modulo the number of parts; null keys give null."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts).cast("bigint"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
