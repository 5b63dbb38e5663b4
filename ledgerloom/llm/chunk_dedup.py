"""Op 7: substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: each byte shifts it by one bit and adds the byte's random number, so its
32 bits depend on the last 32 bytes only. A chunk ends where the hash's upper ``BITS`` bits are zero, after at least
``LEAST`` and at most ``MOST`` bytes; a shorter rest belongs to the chunk before it. As borders depend on
nearby bytes alone, an insertion moves no borders beyond its surroundings. Chunks are compared by a 128-bit digest;
all but the first occurrence (lowest doc_id, then place in the text) are removed.

Defined cases: a null text is empty; a text under ``LEAST`` bytes is one chunk, so that its later copies go;
a shorter rest of a text that was cut is never compared; repeated rows (same id and text) are
one document; an empty table gives no rows; a long text of one repeated byte is cut at ``MOST``; extra columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .occurrences import UNITS, later_spans
from .runtime import PACKED_BYTES, RID, blocks, bytes_of, join_packed, merged, pack, table, unpack, with_rid

#: On prose, chunks of 64 bytes at least (97 on average) meet nearly all repeated passages of 50 words, and few phrases.
LEAST, MOST, BITS = 64, 512, 5


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte, by doubling the bytes it covers."""
    h = (B.byte_values(31)[data] >> np.uint64(32)).astype(np.uint32)
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End and text of each chunk, in order; chunks lie side by side from each text's start."""
    borders = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    low = np.searchsorted(borders, offsets[:-1], "right")
    high = np.searchsorted(borders, offsets[1:], "left")
    ends: list[int] = []
    docs: list[int] = []
    for k, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if start == stop:
            continue
        own = len(ends)
        at = start
        for border in [*borders[low[k] : high[k]].tolist(), stop]:
            while border - at > MOST:
                at += MOST
                ends.append(at)
            if border - at >= LEAST:
                at = border
                ends.append(at)
        if at < stop:
            if len(ends) > own:
                ends[-1] = stop
            else:
                ends.append(stop)
        docs.extend([k] * (len(ends) - own))
    return np.array(ends, np.int64), np.array(docs, np.int64)


def _units(batches):
    for batch in batches:
        for part in blocks(batch, "text"):
            data, offsets = bytes_of(part.column("text"))
            ends, doc = chunk_ends(data, offsets)
            starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
            fits = (ends - starts >= LEAST) | ((starts == offsets[doc]) & (ends == offsets[doc + 1]))
            starts, ends, doc = starts[fits], ends[fits], doc[fits]
            a, b = (B.SpanHash(data, seed)(starts, ends) for seed in (7, 8))
            pick = pa.array(doc)
            spans = [pa.array((x - offsets[doc]).astype(np.int32)) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), part.column("doc_id").take(pick), part.column(RID).take(pick), *spans], ["a", "b", "doc_id", "rid", "start", "stop"])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _strip(full: bool):
    def strip(batches):
        for batch in batches:
            for part in blocks(batch, "text", PACKED_BYTES):
                data, offsets = bytes_of(unpack(part.column("text")))
                rows = []
                for k in range(part.num_rows):
                    raw = data[offsets[k] : offsets[k + 1]]
                    spans = part.column("__sp_starts")[k]
                    a = b = np.zeros(0, np.int64)
                    if spans.is_valid:
                        a, b = merged(np.asarray(spans.values, np.int64), np.asarray(part.column("__sp_stops")[k].values, np.int64))
                    stay = np.ones(len(raw), bool)
                    for x, y in zip(a, b):
                        stay[x:y] = False
                    kept = raw[stay].tobytes()
                    rows.append((part.column("doc_id")[k].as_py(), len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept if full else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return strip


def chunk_dedup(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """Per document what was removed and, if asked for, the bytes that stay (cut anywhere, so not always UTF-8)."""
    slim = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("text", F.col("text").cast("binary"))
    spans = later_spans(slim.mapInArrow(_units, UNITS), "chunks").withColumnRenamed("rid", RID)
    return join_packed(pack(slim), spans, "left").mapInArrow(_strip(with_bytes), OUT)


def op7_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")
