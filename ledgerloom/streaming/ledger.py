"""Streaming forms of the stateless cascade and of monthly totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import expenses as E


def classified(stream: DataFrame) -> DataFrame:
    """Types, merchants and flags of a stream of transactions; no state is needed."""
    rows = C.extract_merchants(C.classify_types(stream)).withColumn("merchant_canonical", F.col("merchant_raw"))
    rows = C.map_categories(rows).withColumn("state", F.lit(None).cast("string"))
    return C.row_flags(rows)


def windowed_totals(stream: DataFrame, time: str, late: str = "2 days", size: str = "1 day") -> DataFrame:
    """The 26 totals of each window; rows later than ``late`` are left out and finished windows leave the state."""
    rows = E.spending(classified(stream)).withWatermark(time, late)
    return rows.groupBy(F.window(time, size)).agg(*E.total_columns()).withColumn("window_start", F.col("window.start")).drop("window")
