"""Op 2: benchmark decontamination by suffix arrays over the words of the training texts.

The training side is cut into shards (blocks of whole texts, ``SHARD`` bytes). A shard keeps only runs of words that the
benchmark has, sorts their suffixes into a suffix array, and every benchmark suffix that can start a window and whose
first two words stand side by side in the shard is searched in it by binary search, word by word, until it ends or no training suffix goes
on with it: that gives its longest verbatim match and all places of its window.

The benchmark goes out in blocks of about ``BLOCK`` bytes, one pass over the training texts for each. One block, the usual
case, needs no shuffle. Several are taken one after the other: each is collected, sent out, its hits are written, and it is
given back before the next, so that the driver and the executors never hold more than one.

A window is ``size`` consecutive words of an item; an item of fewer words is one window. Defined cases: a null
text has no words; an item without words has no window; repeated items count once; a null item_id marks words
but is not listed; item_ids of any type are told as strings; an empty benchmark leaves all documents clean; repeated rows
are judged alike; long texts are a shard of their own; extra columns, of any name, pass through ``decontaminate``
untouched, and those named as HITS are replaced by ``benchmark_hits``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as B
from .runtime import RID, blocks, bytes_of, keep, lists, shielded, small_batches, table, with_rid
from .suffix import suffix_array

WINDOW = 10
#: Bytes of benchmark text that go to the executors at once.
BLOCK = 32 << 20
#: Bytes of training text in a shard.
SHARD = 1 << 21

HITS = [
    T.StructField("__hit_words", T.LongType()),
    T.StructField("__hit_starts", T.ArrayType(T.LongType())),
    T.StructField("__hit_ends", T.ArrayType(T.LongType())),
    T.StructField("__hit_items", T.ArrayType(T.StringType())),
    T.StructField("__hit_longest", T.LongType()),
]


class TestSide:
    """Benchmark suffixes as numbers of words: ``vocabulary`` has the words' hashes in order."""

    def __init__(self, items: list[tuple], size: int):
        data = "\n".join(text or "" for _, text in items).encode()
        low = B.LOWER[np.frombuffer(data, np.uint8)]
        lengths = np.array([len((t or "").encode()) + 1 for _, t in items] or [1])
        offsets = np.minimum(np.concatenate([[0], np.cumsum(lengths)]), len(low))
        words = B.Words(low, offsets, B.ALNUM)
        hashes = B.SpanHash(low)(words.start, words.end)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.ids = np.concatenate([ids + 1, np.zeros(1, np.int64)]).astype(np.int64)
        self.known = np.array([i is not None for i, _ in items], bool)
        # Numbers of items, and their names, as which they are told.
        names = sorted({str(i) for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(names)}
        self.names = np.array(names or [""], object)
        self.item = np.array([-1 if i is None else number[str(i)] for i, _ in items], np.int64)
        self.owner = words.doc
        left = words.first[words.doc + 1] - np.arange(len(words))
        whole = np.diff(words.first)[words.doc]
        # Words that a match must have to be a window: none can be one if the item is long and ends too soon.
        self.need = np.where(left >= size, size, np.where(left == whole, left, np.iinfo(np.int64).max))
        self.left = left
        self.least = int(self.need.min()) if len(left) else 0
        # Suffixes that can start a window, by their first two words (the second is 0 where there is but one).
        able = np.flatnonzero(self.need < np.iinfo(np.int64).max)
        first = self._pairs(self.ids[able], np.where(self.need[able] > 1, self.ids[able + 1], 0))
        order = np.argsort(first, kind="stable")
        self.able, self.first = able[order], first[order]

    def _pairs(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one * np.int64(len(self.vocabulary) + 1) + two

    def starting(self, seq: np.ndarray) -> np.ndarray:
        """The suffixes that can start a window and whose first two words (one, if that is a window) stand in ``seq``."""
        there = np.unique(np.concatenate([self._pairs(seq[:-1], seq[1:]), self._pairs(seq, 0)]))
        at = np.searchsorted(there, self.first)
        at[at == len(there)] = 0
        return self.able[there[at] == self.first]

    def search(self, seq: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix its longest match, and the range of the suffix array where its window stands."""
        n = len(self.left)
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at_lo, at_hi, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        padded = np.concatenate([seq, np.zeros(1, seq.dtype)])
        active, depth = self.starting(seq), 0
        hi[active] = len(order)
        while len(active):
            want = self.ids[active + depth]
            bounds = []
            for above in (0, 1):  # the first suffix not under the word, then the first over it
                a, b = lo[active], hi[active]
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    there = padded[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(seq))]
                    less = there < want + above
                    a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
                bounds.append(a)
            lo[active], hi[active] = bounds
            found = bounds[0] < bounds[1]
            active = active[found]
            depth += 1
            longest[active] = depth
            done = active[self.need[active] == depth]
            at_lo[done], at_hi[done] = lo[done], hi[done]
            active = active[self.left[active] > depth]
        return longest, at_lo, at_hi


def shard_hits(data: np.ndarray, offsets: np.ndarray, side: TestSide):
    """n_words, span starts, span ends (in words of the text), items, longest match: one of each per text."""
    docs = len(offsets) - 1
    low = B.LOWER[data]
    words = B.Words(low, offsets, B.ALNUM)
    n_words = np.diff(words.first)
    none = [np.zeros(0, np.int64)] * docs
    empty = (n_words, none, none, none, np.zeros(docs, np.int64))
    if not len(words) or not len(side.vocabulary):
        return empty
    hashes = B.SpanHash(low)(words.start, words.end)
    ids = np.searchsorted(side.vocabulary, hashes)
    ids[ids == len(side.vocabulary)] = 0
    inside = side.vocabulary[ids] == hashes
    # Runs of benchmark words inside one text; only those long enough can hold a window.
    edge = np.zeros(len(words) + 1, bool)
    edge[words.first] = True
    begin = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]]))
    end = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:-1], [True]])) + 1
    fits = end - begin >= side.least
    begin, end = begin[fits], end[fits]
    if not len(begin):
        return empty
    size = end - begin
    shift = np.cumsum(size + 1) - size - 1
    place = np.repeat(begin - shift, size + 1) + np.arange((size + 1).sum())  # word of each symbol
    seq = np.where(place < np.repeat(end, size + 1), ids[np.minimum(place, len(words) - 1)] + 1, 0)
    order = suffix_array(seq)
    longest, lo, hi = side.search(seq, order)
    hit = np.flatnonzero(hi > lo)
    longest_of = np.zeros(docs, np.int64)
    if not len(hit):
        return empty
    ranges, which = np.unique(np.stack([lo[hit], hi[hit], side.need[hit]]), axis=1, return_inverse=True)
    count = ranges[1] - ranges[0]
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = place[order[np.repeat(ranges[0], count) + k]]
    size = np.repeat(ranges[2], count)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + size, -1)
    covered = np.cumsum(cover)[:-1] > 0
    up = np.flatnonzero(covered & np.concatenate([[True], ~covered[:-1] | edge[1:-1]]))
    down = np.flatnonzero(covered & np.concatenate([~covered[1:] | edge[1:-1], [True]])) + 1
    doc = words.doc[up]
    cut = np.searchsorted(doc, np.arange(1, docs))
    starts, ends = np.split(up - words.first[doc], cut), np.split(down - words.first[doc], cut)
    # Items: each window's texts with each window's items, without repeats.
    rid = np.repeat(np.arange(len(count)), count)
    pairs = np.unique(np.stack([rid, words.doc[first]]), axis=1)
    best = np.zeros(len(count), np.int64)
    np.maximum.at(best, which.ravel(), longest[hit])
    np.maximum.at(longest_of, pairs[1], best[pairs[0]])
    owners = np.unique(np.stack([which.ravel(), side.owner[hit]]), axis=1)
    owners = owners[:, side.known[owners[1]]]
    low_, high_ = np.searchsorted(owners[0], pairs[0], "left"), np.searchsorted(owners[0], pairs[0], "right")
    n = high_ - low_
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low_, n)
    named = np.unique(np.stack([np.repeat(pairs[1], n), side.item[owners[1][k]]]), axis=1)
    items = np.split(side.names[named[1]], np.searchsorted(named[0], np.arange(1, docs)))
    return n_words, starts, ends, items, longest_of


def _pass(shared, names: list[str]):
    def scan(batches):
        side = shared.value
        for batch in batches:
            at = names.index("text")
            for part in blocks(batch, "text", SHARD):
                n_words, starts, ends, items, longest = shard_hits(*bytes_of(part.column(at)), side)
                found = [pa.array(n_words, pa.int64()), lists(starts), lists(ends), lists(items, pa.string()), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names + [f.name for f in HITS])

    return scan


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The columns of docs and those of HITS; docs needs the columns doc_id and text (a string)."""
    spark = docs.sparkSession
    small_batches(spark)
    fields = [f.name for f in HITS]
    docs = docs.drop(*fields)
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block))

    def scanned(rows: DataFrame, part: DataFrame):
        shared = spark.sparkContext.broadcast(TestSide([tuple(r) for r in part.collect()], size))
        return rows.mapInArrow(_pass(shared, rows.columns), T.StructType(rows.schema.fields + HITS)), shared

    safe, names = shielded(docs, "doc_id", "text")
    if n == 1:
        return scanned(safe, items)[0].toDF(*docs.columns, *fields)
    slim, found = with_rid(docs.select("doc_id", "text")).drop("doc_id"), None
    for k in range(n):
        hits, shared = scanned(slim, items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k))
        hits = hits.drop("text")
        # Repeated rows have the same hits. The first pass tells the words of all documents.
        part = keep((hits if k == 0 else hits.filter(F.size("__hit_starts") > 0)).dropDuplicates([RID]), f"hits-{k}")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    joined = lambda name: F.flatten(F.collect_list(name)).alias(name)
    found = found.groupBy(RID).agg(F.max("__hit_words").alias("__hit_words"), *map(joined, fields[1:4]), F.max("__hit_longest").alias("__hit_longest"))
    return with_rid(safe).join(found, RID).select(*names, *fields).toDF(*docs.columns, *fields)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of the benchmark."""
    safe, names = shielded(docs, "doc_id", "text")
    return benchmark_hits(safe, benchmark, size).filter(F.size("__hit_starts") == 0).select(names).toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256, contaminated, and the longest match's words."""
    hits = benchmark_hits(docs.select("doc_id", "text"), benchmark, size, block)
    # Passes over several blocks give spans that may overlap: they are merged over the sorted ends.
    spans = F.expr("array_sort(arrays_zip(__hit_starts, __hit_ends))")
    hit = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["__hit_ends"] - F.greatest(x["__hit_starts"], s["to"]))).alias("n"),
            F.greatest(s["to"], x["__hit_ends"]).alias("to"),
        ),
        lambda s: s["n"],
    )
    items = F.array_sort(F.array_distinct("__hit_items"))
    return hits.select(
        "doc_id",
        F.col("__hit_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("__hit_starts") > 0).alias("contaminated"),
        F.col("__hit_longest").alias("longest_match"),
    )


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


ORACLE_SQL = {
    "op2_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.t = x.t
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
}


#: The same rule in plain Python, for tests.
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def plain_words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def digest_of(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()
