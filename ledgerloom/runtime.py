"""What operators share: tables written to cut lineage, and values bound once in an expression."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Without this, each mention repeats the whole expression of the value in the plan, and predicates that are
    pushed down repeat it again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local master may fall back to a temp folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_dir()


@functools.lru_cache(1)
def _local_dir() -> str:
    where = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/ledgerloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the application's own part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the application's own part of the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> bool:
    """Deletes all tables that ``keep`` wrote in this application; results that are still to be computed from them are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Parts that rows without a key are dealt over.
SPREAD = 1024


def left_join_spread(left: DataFrame, right: DataFrame, key: str, *by: str) -> DataFrame:
    """left joined with right (one row for each key). Rows without a key, null or empty, match nothing: they are dealt out by the columns ``by``, not all to one task."""
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("string"))
    has = F.coalesce(F.col(key) != "", F.lit(False))
    rows = left.withColumn("__to", F.when(has, F.col(key)).otherwise(spread))
    return rows.join(right.withColumnRenamed(key, "__of"), has & (F.col("__to") == F.col("__of")), "left").drop("__to", "__of")

