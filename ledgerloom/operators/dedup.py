"""Removal of repeated rows and of mirrored transfers, over ordered rows (seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


REFERENCE = r"(?iu)\bREF\s*[:=]?\s*([A-Z0-9-]+)"
TRANSFERS = ["internal_transfer", "external_transfer"]


def exact_key() -> list[Column]:
    text = F.trim(F.regexp_replace(F.upper(F.coalesce("raw_description", F.lit(""))), r"(?U)\s+", " "))
    return [F.col("booking_date"), F.bround("amount", 2), F.col("direction"), F.col("source_section"), text]


def without_repeats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the removed rows (transaction_id, seq).

    The first seq of each key is found by partial sums, so that a row repeated a million times is one row a task before it is
    shuffled; rows then meet the first ones by seq, whose values are all different.
    """
    firsts = df.groupBy(*[k.alias(f"__k{n}") for n, k in enumerate(exact_key())]).agg(F.min("seq").alias("seq")).select("seq")
    return df.join(firsts, "seq", "left_semi"), df.join(firsts, "seq", "left_anti").select("transaction_id", "seq")


def reference() -> Column:
    """The reference of a transfer, null without one and for other rows."""
    found = F.nullif(F.upper(F.regexp_extract(F.coalesce("raw_description", F.lit("")), REFERENCE, 1)), F.lit(""))
    return F.when(F.col("txn_type").isin(TRANSFERS), found)


def without_mirrors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each transfer reference, amount and type: the first, or the first credit if the first is a debit.

    The survivor takes the first row's place (column seq); removed rows keep theirs.
    """
    rows = df.withColumn("__ref", reference())
    plain, tied = rows.filter("__ref is null").drop("__ref"), rows.filter("__ref is not null")
    group = Window.partitionBy("__ref", F.bround("amount", 2), "txn_type")
    tied = tied.withColumns({"__place": F.min("seq").over(group), "__first": F.min_by("direction", "seq").over(group)})
    better = (F.col("__first") == "debit") & (F.col("direction") == "credit")
    tied = tied.withColumn("__k", F.row_number().over(group.orderBy(better.desc(), "seq")))
    kept = tied.filter("__k = 1").withColumn("seq", F.col("__place")).drop("__ref", "__place", "__first", "__k")
    return plain.unionByName(kept), tied.filter("__k > 1").select("transaction_id", "seq")


def deduplicate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both removals; the removed rows carry the reason."""
    once, repeats = without_repeats(df)
    kept, mirrors = without_mirrors(once)
    return kept, repeats.withColumn("reason", F.lit("repeat")).unionByName(mirrors.withColumn("reason", F.lit("mirror")))
