"""Price files, JSON documents and stored tables with the keys under which they stay valid."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.sources.bars import aliased

#: Rows that a file needs alone, and that an adjusted series needs in a pair.
LEAST_ROWS, LEAST_PAIRED = 50, 275
#: Columns by the names under which files have them.
ALIASES = {"date": ["date", "trade_date", "day"], "open": ["open"], "high": ["high"], "low": ["low"], "close": ["close"], "volume": ["volume", "vol"], "amount": ["amount", "turnover"]}


def price_files(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder in one scan: code and basis (raw, adjusted) from the file name, then the price columns.

    A file is CODE_anything.csv, raw if _raw_ stands in its name. The files share one header; one that differs is an error.
    Rows without a date or close that can be read are left out.
    """
    lines = spark.read.option("header", True).option("enforceSchema", False).csv(f"{folder}/*.csv")
    name = F.col("_metadata.file_name")
    rows = lines.select("*", F.substring_index(name, "_", 1).alias("__code"), F.when(name.contains("_raw_"), "raw").otherwise("adjusted").alias("__basis"))
    values = aliased(rows, {"code": ["__code"], "basis": ["__basis"], **ALIASES})
    typed = values.select("code", "basis", F.expr("try_cast(date AS date)").alias("date"), *[F.expr(f"try_cast({c} AS double)").alias(c) for c in values.columns[3:]])
    return typed.where("date IS NOT NULL AND close IS NOT NULL")


def long_enough(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """The series (code, basis) that have at least so many rows."""
    counts = rows.groupBy("code", "basis").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return rows.join(counts.select("code", "basis"), ["code", "basis"], "left_semi")


def price_pairs(rows: DataFrame, least: int = LEAST_PAIRED) -> DataFrame:
    """Rows of those codes that have both bases, with at least so many adjusted rows."""
    have = rows.groupBy("code").agg(F.count_if(F.col("basis") == "raw").alias("raw"), F.count_if(F.col("basis") == "adjusted").alias("adjusted"))
    return rows.join(have.where((F.col("raw") > 0) & (F.col("adjusted") >= least)).select("code"), "code", "left_semi")


def write_series(rows: DataFrame, folder: str, stamp: str) -> None:
    """One folder a code, as CSV with the stamp in a column; what older stamps left for these codes is replaced."""
    out = rows.withColumn("stamp", F.lit(stamp)).repartition("code")
    out.write.option("partitionOverwriteMode", "dynamic").option("header", True).mode("overwrite").partitionBy("code").csv(folder)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, document (variant, null if broken) and status (OK, INVALID) of every JSON file under a path."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("document"))
    is_object = F.schema_of_variant("document").startswith("OBJECT")
    return files.select("file", F.when(is_object, F.col("document")).alias("document"), F.when(is_object, "OK").otherwise("INVALID").alias("status"))


def save_rows(rows: DataFrame, folder: str, keys: Mapping[str, object]) -> None:
    """Write a table, then the manifest that names it with its keys and row count; readers see the old table until then."""
    spark, name = rows.sparkSession, f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    count = spark.read.parquet(f"{folder}/{name}").count()
    manifest = json.dumps({"table": name, "rows": count, "keys": dict(keys)}, sort_keys=True)
    spark.createDataFrame([(uuid.uuid4().hex, manifest)], "id string, value string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def load_rows(spark: SparkSession, folder: str, keys: Mapping[str, object]) -> DataFrame | None:
    """The stored table, if its latest manifest has exactly these keys and its rows are all there; else None."""
    try:
        latest = spark.read.parquet(f"{folder}/manifest").agg(F.max_by("value", F.struct("at", "id")).alias("value")).first()["value"]
        manifest = json.loads(latest)
        if manifest["keys"] != json.loads(json.dumps(dict(keys))) or not manifest["rows"]:
            return None
        rows = spark.read.parquet(f"{folder}/{manifest['table']}")
        return rows if rows.count() == manifest["rows"] else None
    except AnalysisException:  # nothing was stored there, or the table is gone
        return None


def save_epoch(rows: DataFrame, folder: str, epoch: int) -> None:
    """Write a run's state under its epoch, then the line that names it. A repeated epoch takes the place of its first run."""
    spark, name = rows.sparkSession, f"epoch-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(epoch, name)], "epoch long, table string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/epochs")


def load_epoch(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The state of the last epoch before one, so that a repeated run reads what its first one read; None if there is none."""
    try:
        lines = spark.read.parquet(f"{folder}/epochs").where(F.col("epoch") < before)
    except AnalysisException:  # nothing was stored there
        return None
    name = lines.agg(F.max_by("table", F.struct("epoch", "at", "table"))).first()[0]
    return None if name is None else spark.read.parquet(f"{folder}/{name}")
