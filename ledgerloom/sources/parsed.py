"""A table of parsed statements that grows: only files whose content is new are parsed.

A file is known by its content (version and SHA-256), so a renamed or repeated file is not parsed again, and a changed one is. A
run takes the keys that the table does not have, writes their entries under a name that follows from these keys, and then
writes the keys themselves, which commits the entries. A run that breaks off in between leaves no keys: the next one has
the same name and writes the same folder anew, so that nothing is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import statements as P
from ..runtime import keep
from .tables import file_keys

KEYS = "cache_key string, run string"


def page_keys(pages: DataFrame, version: str = "v3") -> DataFrame:
    """doc_id and cache_key of documents given as pages (doc_id, page_no, text): the digest of their pages' digests, in order."""
    each = F.struct("page_no", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    listed = F.array_sort(F.collect_list(each))
    return pages.groupBy("doc_id").agg(F.concat(F.lit(f"{version}:"), F.sha2(F.array_join(F.transform(listed, lambda p: p["h"]), "").cast("binary"), 256)).alias("cache_key"))


def _committed(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(KEYS).parquet(f"{store}/keys")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], KEYS)
        raise


def new_documents(pages: DataFrame, keys: DataFrame, store: str) -> DataFrame:
    """doc_id and cache_key of one document for each content that the table does not have."""
    known = _committed(pages.sparkSession, store)
    return keys.join(known, "cache_key", "left_anti").groupBy("cache_key").agg(F.min("doc_id").alias("doc_id"))


def run_name(new: DataFrame) -> str | None:
    """A name that follows from the set of new keys, whatever their order; None for no keys."""
    n, total, mixed = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("cache_key").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "cache_key"))).first()
    return f"{n}-{int(total) & (1 << 64) - 1:016x}{int(mixed) & (1 << 64) - 1:016x}" if n else None


def write_entries(pages: DataFrame, new: DataFrame, store: str, run: str) -> None:
    """Parses the new documents and writes their entries; they count only once their keys are committed."""
    own = pages.join(new, "doc_id").select("cache_key", "page_no", "text").withColumnRenamed("cache_key", "doc_id")
    rows = P.parse_statements(own).withColumnRenamed("doc_id", "cache_key")
    rows.write.mode("overwrite").parquet(f"{store}/entries/run={run}")


def commit(new: DataFrame, store: str, run: str) -> None:
    new.select("cache_key", F.lit(run).alias("run")).write.mode("append").parquet(f"{store}/keys")


def parse_new(pages: DataFrame, store: str, keys: DataFrame | None = None) -> int:
    """Parses what is new among pages (doc_id, page_no, text) into the table; how many documents that were.

    keys: doc_id and cache_key, as page_keys (the default) or keys_of_files give them.
    """
    keys = page_keys(pages) if keys is None else keys
    # Written out: once the keys are committed, they would not be new any more.
    new = keep(new_documents(pages, keys, store), "new-documents")
    run = run_name(new)
    if run is None:
        return 0
    write_entries(pages, new, store, run)
    commit(new, store, run)
    return int(run.split("-")[0])


def keys_of_files(spark: SparkSession, path: str, version: str = "v3") -> DataFrame:
    """doc_id (the file) and cache_key of the files of a folder."""
    return file_keys(spark, path, version).withColumnRenamed("path", "doc_id")


def parsed(spark: SparkSession, store: str, keys: DataFrame) -> DataFrame:
    """The entries of the documents in keys (doc_id, cache_key), as if all had been parsed at once."""
    runs = _committed(spark, store)
    rows = spark.read.parquet(f"{store}/entries").join(runs, ["cache_key", "run"], "left_semi").drop("run")
    return keys.join(rows, "cache_key").drop("cache_key")
