"""First and later occurrences of hashed units (chunks, line windows) over a whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import keep

#: What units need: a digest in two halves, the document's id and row key, and where the unit starts and stops.
UNITS = "a long, b long, doc_id long, rid binary, start int, stop int"


def later_spans(units: DataFrame, name: str) -> DataFrame:
    """rid, __sp_starts, __sp_stops of every unit whose digest stands earlier: in a lower doc_id (null is lowest), or further up in
    a text of the same id.

    Rows are counted before they are shuffled, so a digest that a third of all documents share is one row for
    each task there. The digests that repeat are written out; the join with them can be split where it is skewed.
    """
    # One number for each place, not a struct: fixed-size values are aggregated by hash, structs by sorting all rows.
    order = F.coalesce("doc_id", F.lit(-(1 << 63))).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("start")
    units = keep(units, name).withColumn("place", order.cast("decimal(38,0)"))
    firsts = units.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    firsts = keep(firsts.filter("first != last").drop("last"), f"{name}-first")
    later = units.join(firsts, ["a", "b"]).filter("place != first")
    return later.groupBy("rid").agg(F.collect_list("start").alias("__sp_starts"), F.collect_list("stop").alias("__sp_stops"))
