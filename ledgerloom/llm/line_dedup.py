"""Op 8: line dedup by overlapping windows of three lines.

Lines are what stands between line breaks. Three consecutive lines of a text, hashed together, are a window;
windows without any word are left out. A window that stands earlier, in a document of lower doc_id or further up
in the same text, is a later occurrence; the lines that later occurrences cover are merged and removed.

Defined cases: a null text has no lines and stays null; texts of fewer than three lines stay whole; repeated rows
(same id and text) are one document, each other equal text is later than the lowest doc_id's; an empty table
gives no rows; long texts are cut whole; extra columns, of any name, pass through ``without_repeated_lines``, which leaves
out a text that loses all its lines; ``line_dedup`` replaces those of its own names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as B
from .occurrences import UNITS, later_spans
from .runtime import PACKED_BYTES, RID, blocks, bytes_of, join_packed, merged, pack, shielded, table, unpack, with_rid

WINDOW = 3


def line_windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW):
    """Text, first line and the two halves of the digest of each window that has a word."""
    starts, ends, doc, first = B.line_spans(data, offsets)
    halves = [B.gram_hashes(B.SpanHash(data, seed)(starts, ends), size, seed) for seed in (7, 8)]
    at = np.flatnonzero(B.window_starts(first, size)[: len(halves[0])])
    total = np.concatenate([[0], np.cumsum(B.SPACED[data])])
    at = at[total[ends[at + size - 1]] > total[starts[at]]] if len(at) else at
    return doc[at], at - first[doc[at]], halves[0][at], halves[1][at]


def _units(size: int):
    def units(batches):
        for batch in batches:
            k = 0
            for part in blocks(batch, "text"):
                ids, rids = part.column("doc_id"), part.column(RID)
                doc, line, a, b = line_windows(*bytes_of(part.column("text")), size)
                k += part.num_rows
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), ids.take(pick), rids.take(pick), pa.array(line.astype(np.int32)), pa.array((line + size).astype(np.int32))], ["a", "b", "doc_id", "rid", "start", "stop"]
                )

    return units


def _cut(names: list[str]):
    def cut(batches):
        for batch in batches:
            for part in blocks(batch, "text", PACKED_BYTES):
                column = unpack(part.column("text"))
                data, offsets = bytes_of(column)
                starts, ends, _, first = B.line_spans(data, offsets)
                texts, lines, gone = [], [], []
                for k in range(part.num_rows):
                    low, high = first[k], first[k + 1]
                    spans = part.column("__sp_starts")[k]
                    n = 0
                    text = column[k].as_py()
                    if spans.is_valid:
                        a, b = merged(np.asarray(spans.values, np.int64), np.asarray(part.column("__sp_stops")[k].values, np.int64))
                        stay = np.ones(high - low, bool)
                        for x, y in zip(a, b):
                            stay[x:y] = False
                        n = int((~stay).sum())
                        at = np.flatnonzero(stay) + low
                        text = b"\n".join(data[x:y].tobytes() for x, y in zip(starts[at], ends[at]))
                    texts.append(text)
                    lines.append(int(high - low) if text is not None else 0)
                    gone.append(n)
                out = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*out, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*names, "__ld_lines", "__ld_removed"])

    return cut


def line_dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The columns of docs, text without its later lines, and __ld_lines and __ld_removed, numbers of lines."""
    docs = docs.drop("__ld_lines", "__ld_removed")
    safe, names = shielded(docs, "doc_id", "text")
    keyed = with_rid(safe)
    slim = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), RID, "text").filter("text is not null")
    spans = later_spans(slim.mapInArrow(_units(size), UNITS), "line-windows").withColumnRenamed("rid", RID)
    raw = join_packed(pack(keyed.withColumn("text", F.col("text").cast("binary"))), spans, "left")
    schema = T.StructType(safe.schema.fields + [T.StructField("__ld_lines", T.LongType()), T.StructField("__ld_removed", T.LongType())])
    return raw.mapInArrow(_cut(names), schema).toDF(*docs.columns, "__ld_lines", "__ld_removed")


def without_repeated_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without repeated lines; a text that loses all its lines goes."""
    safe, names = shielded(docs, "doc_id", "text")
    out = line_dedup(safe, size)
    return out.filter(~((F.col("__ld_removed") > 0) & (F.col("__ld_removed") == F.col("__ld_lines")))).select(names).toDF(*docs.columns)


def op8_line_window_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__ld_lines").alias("n_lines"), F.col("__ld_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op8_line_window_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, i, line, lead(line) OVER d AS line2, lead(line, 2) OVER d AS line3 FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), h AS (
  SELECT doc_id, i, sha256(line || chr(10) || line2 || chr(10) || line3) AS h FROM w
  WHERE line3 IS NOT NULL AND regexp_matches(line || line2 || line3, '[^\x20\x09-\x0D]')
), later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1), (2)) AS v(k)
), s AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
}
