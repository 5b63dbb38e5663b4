"""Shared pieces: scratch tables, Arrow helpers, row keys and span merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import keep  # noqa: F401

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
BLOCK_BYTES = 1 << 19
#: Rows of an Arrow batch: Spark's own default of 10,000 is far too many for rows that hold whole texts.
BATCH_ROWS = 1000
#: Compressed bytes that are unpacked at once.
PACKED_BYTES = 1 << 18
RID = "__ll_rid"


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch, unless the session has its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_rid(docs: DataFrame) -> DataFrame:
    """Adds a row key from doc_id and text: repeated rows share it, equal ids with other texts do not.

    It is a digest of 128 bits, so that no two of 10^11 documents are ever taken for one.
    """
    small_batches(docs.sparkSession)
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "n").otherwise(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn(RID, F.unhex(F.md5(own.cast("binary"))))


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """docs with all columns but the ``used`` ones renamed, so that none can clash with an operator's own; and their names.

    ``result.toDF(*docs.columns)`` gives them their names back.
    """
    names = [n if n in used else f"__own_{k}" for k, n in enumerate(docs.columns)]
    return docs.toDF(*names), names


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its n + 1 offsets; a null is empty."""
    n, buffers = len(column), column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:
        size = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if (size != np.diff(offsets)).any():
            data = np.concatenate([data[a : a + s] for a, s in zip(offsets[:-1], size)] or [data[:0]])
            offsets = np.concatenate([[0], np.cumsum(size)])
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES):
    """Slices of a batch that hold about ``most`` bytes of text each."""
    if batch.num_rows == 0:
        return
    _, offsets = bytes_of(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        yield batch.slice(first, last - first)
        first = last


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, touching ones joined, in order."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([new[1:], [True]])
    return starts[new], ends[last]


def lists(arrays: list[np.ndarray], kind=None) -> pa.Array:
    """A list column from one array per row."""
    kind = kind or pa.int64()
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat if len(flat) else [], kind))


def _appended(names: list[str], fields: list[str], make):
    def appended(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(*bytes_of(part.column(at)))], names + fields)

    return appended


def append_columns(docs: DataFrame, fields: list, make) -> DataFrame:
    """docs with more columns, which ``make`` gives for the bytes and offsets of a block of texts."""
    from pyspark.sql import types as T

    added = [f.name for f in fields]
    safe, names = shielded(docs, "text")
    return safe.mapInArrow(_appended(names, added, make), T.StructType(safe.schema.fields + fields)).toDF(*docs.columns, *added)


def _packed(column: str, names: list[str]):
    def packed(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in blocks(batch, column):
                arrays = [pa.array([squeeze(x.as_buffer()) if x.is_valid else None for x in part.column(n)], pa.binary()) if n == column else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return packed


def pack(df: DataFrame, column: str = "text") -> DataFrame:
    """Compresses a binary column before it is dealt out: half the bytes that the shuffle's own codec leaves."""
    return df.mapInArrow(_packed(column, df.columns), df.schema)


def join_packed(packed: DataFrame, other: DataFrame, how: str = "inner", key: str = RID) -> DataFrame:
    """packed joined with other by row key, always through a shuffle.

    A broadcast of a small ``other`` would leave the packing and the Python step after it in one stage. Each task there
    has two workers, and executors keep all workers they ever had, so later steps would hold their tables in twice as many.
    """
    return packed.join(other.hint("merge"), key, how)


def unpack(column: pa.Array) -> pa.Array:
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    return pa.array([grow(x.as_buffer()) if x.is_valid else None for x in column], pa.binary())
