"""Recursive smoothing with the state at every row.

Spark's aggregate function folds an array but returns one state; an array that it grows by a state a step is copied each time. A scan
is therefore one pass of plain arithmetic over an instrument's rows in order of date, in Arrow batches by instrument. A group is one history,
bounded by the length of the calendar, whatever the size of the panel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def exponential_means(values: list[float | None], weight: float) -> list[float | None]:
    """The exponential mean at every value, seeded by the first; a null keeps the mean as it was."""
    out, mean, rest = [], None, 1 - weight
    for value in values:
        if value is not None:
            mean = value if mean is None else mean * rest + value * weight
        out.append(mean)
    return out


def smoothed(bars: DataFrame, means: dict[str, tuple[str, float]], *columns: str) -> DataFrame:
    """bars with exponential means beside each row: name -> (column, weight of the new value), seeded by an instrument's first row.

    Keeps code, date and columns (which have to hold those that are smoothed); rows of an equal date keep any order among themselves.
    """
    kept = ["code", "date", *columns]
    schema = StructType([*(bars.schema[c] for c in kept), *(StructField(k, DoubleType()) for k in means)])

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        for name, (column, weight) in means.items():
            rows = rows.append_column(name, pa.array(exponential_means(rows.column(column).to_pylist(), weight), pa.float64()))
        return rows

    return bars.select(*[F.col(c) for c in kept]).groupBy("code").applyInArrow(scan, schema)
