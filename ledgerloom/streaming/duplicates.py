"""Removal of repeated rows and of mirrored transfers over streams, with state that leaves once the watermark has passed.

Both agree with the batch forms on rows that are no further apart than the delay, where the first row that arrives is the
first one. Rows later than the delay are left out by the watermark, as any late row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup as D

KEYS = [f"__key{k}" for k in range(5)]
TIED = ["__ref", "__cents", "txn_type"]


def without_repeats(stream: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """The first row of each key of the batch form; a row again more than ``late`` after it is a new one."""
    keyed = stream.withColumns(dict(zip(KEYS, D.exact_key())))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(KEYS).drop(*KEYS)


def without_mirrors(stream: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """One row for each transfer reference, amount and type: the first by seq, or the first credit if the first is a debit, in
    the first one's place (seq), as in the batch form, once the watermark has passed them.

    Rows of a key no more than ``late`` apart are one session, whose first rows are partial sums: neither the order in which rows
    arrive nor their number matters, and state leaves with the watermark. Rows without a reference pass beside it.
    """
    rows = stream.withColumns({"__ref": D.reference(), "__cents": F.bround("amount", 2)}).withWatermark(time, late)
    session = F.session_window(time, f"{late} 1 microsecond")  # sessions end before their gap does
    row, credit = F.struct(*stream.columns), F.col("direction") == "credit"
    firsts = {"__first": F.min_by(row, "seq"), "__credit": F.min_by(F.when(credit, row), F.when(credit, F.col("seq")))}
    both = rows.filter("__ref is not null").groupBy(*TIED, session).agg(*[c.alias(n) for n, c in firsts.items()])
    kept = both.withColumn("__row", F.when(F.col("__first.direction") == "debit", F.coalesce("__credit", "__first")).otherwise(F.col("__first")))
    kept = kept.select(*[F.col("__first.seq" if c == "seq" else f"__row.{c}").alias(c) for c in stream.columns])
    return rows.filter("__ref is null").select(stream.columns).unionByName(kept)
