"""As-of join: each row with the last version of its key at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import keep


def as_of(rows: DataFrame, versions: DataFrame, key: str, time: str, unit: str = "day", strict: bool = False) -> DataFrame:
    """The columns of rows, and ``version``: a struct of the last row of versions of that key with a time no later (``strict``: earlier).

    Of versions of one time the greatest counts. Rows without a key or a time, or before the first version, have no version.

    Time is cut into buckets (``unit`` as date_trunc takes it). The last version of each key and bucket is found by partial
    maxima; what a bucket starts with is the last of those before it, over one row a bucket; and only rows and versions of one key and one bucket
    meet in a window. So a key that a third of all rows have is as many groups as the buckets it is in.
    """
    names = rows.columns
    bucket = F.date_trunc(unit, F.col(time))
    fields = F.struct(*[F.col(c) for c in versions.columns if c != key])
    v = versions.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__key"), F.col(time).alias("__time"), bucket.alias("__bucket"), F.struct(F.col(time).alias("t"), fields.alias("v")).alias("__last"))
    has = F.col(key).isNotNull() & F.col(time).isNotNull()
    r = rows.filter(has).select(F.col(key).alias("__key"), F.col(time).alias("__time"), bucket.alias("__bucket"), F.struct(*names).alias("__row"))
    # What each bucket starts with: only buckets with rows need it.
    held = v.groupBy("__key", "__bucket").agg(F.max("__last").alias("__last"))
    used = r.select("__key", "__bucket").distinct()
    spine = held.unionByName(used, allowMissingColumns=True).groupBy("__key", "__bucket").agg(F.max("__last").alias("__last"), F.lit(1).alias("__one"))
    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = spine.select("__key", "__bucket", F.last("__last", ignorenulls=True).over(earlier).alias("__last")).filter("__last is not null").join(used, ["__key", "__bucket"], "left_semi")
    none = F.lit(None)
    kinds = {"first": 0, "version": 2 if strict else 1, "row": 1 if strict else 2}
    feed = start.select("__key", "__bucket", none.cast(v.schema["__time"].dataType).alias("__time"), F.lit(kinds["first"]).alias("__kind"), "__last", none.cast(r.schema["__row"].dataType).alias("__row"))
    feed = feed.unionByName(v.select("__key", "__bucket", "__time", F.lit(kinds["version"]).alias("__kind"), "__last", none.cast(r.schema["__row"].dataType).alias("__row")))
    feed = feed.unionByName(r.select("__key", "__bucket", "__time", F.lit(kinds["row"]).alias("__kind"), none.cast(v.schema["__last"].dataType).alias("__last"), "__row"))
    # Nulls come first, and a start is null in time; of versions of one time the greatest comes last.
    seen = Window.partitionBy("__key", "__bucket").orderBy("__time", "__kind", "__last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = feed.withColumn("__seen", F.last("__last", ignorenulls=True).over(seen)).filter(F.col("__kind") == kinds["row"])
    out = met.select("__row.*", F.col("__seen.v").alias("version"))
    return out.unionByName(rows.filter(~has).withColumn("version", none.cast(out.schema["version"].dataType)))


def last_evidence(rows: DataFrame, time: str) -> DataFrame:
    """seq, entity_key and the last confirming row of the entity before each transfer (from_seq, category), by time.

    rows: as own_evidence gives them. Where the memory of entities keeps the first confirming row, this is the dated form: what was last known then.
    """
    # Written out: rows and versions are read several times, and the evidence is a long cascade.
    slim = rows.filter(F.col("txn_type").isin("external_transfer", "salary_income")).select("seq", "entity_key", time, F.col("__own.state").alias("state"), F.col("__own.category_area").alias("category"))
    slim = keep(slim, "dated-evidence")
    versions = slim.filter("state = 'confirmed'").select("entity_key", time, F.col("seq").alias("from_seq"), "category")
    out = as_of(slim.select("seq", "entity_key", time), versions, "entity_key", time, strict=True)
    return out.select("seq", "entity_key", F.col("version.from_seq").alias("from_seq"), F.col("version.category").alias("category"))
