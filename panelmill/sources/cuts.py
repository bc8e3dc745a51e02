"""Cuts in lineage: a table that several branches of a query read is derived once and kept as Parquet."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SHARED: ContextVar[dict | None] = ContextVar("shared", default=None)


def stored(rows: DataFrame) -> DataFrame:
    """Write a table below the folder that spark.checkpoint.dir names (a temporary one where that is empty) and read it again."""
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="panelmill-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/panelmill-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def sharing(query: Callable) -> Callable:
    """The query, in one call of which every source marked as shared is derived once, however many branches read it."""

    @functools.wraps(query)
    def run(*args, **kwargs):
        if _SHARED.get() is not None:
            return query(*args, **kwargs)
        token = _SHARED.set({})
        try:
            return query(*args, **kwargs)
        finally:
            _SHARED.reset(token)

    return run


def shared(source: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A source of (spark, sf_dir, ...) that is stored at its first use within a sharing query; elsewhere it stays lazy."""

    @functools.wraps(source)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = _SHARED.get()
        if kept is None:
            return source(spark, sf_dir)
        key = (source.__name__, id(spark), sf_dir)
        if key not in kept:
            kept[key] = stored(source(spark, sf_dir))
        return kept[key].select("*")

    return read
