"""Op 1: suffix-array dedup of byte substrings that stand at two places or more.

Every window of ``size`` bytes goes to the shard of its smallest 64-byte hash. Equal windows have the same
smallest hash, so they meet in one shard, and consecutive windows with one smallest hash travel as one piece.
Equal pieces are counted before they are dealt out, and keys that stand once in the whole corpus are left out
(their windows cannot repeat). Each shard sorts its suffixes by induced sorting, computes the permuted
common prefixes, and marks the windows that share ``size`` bytes with a neighbour in the suffix array.

A passage that very many documents share has one key and, as each document goes on in its own way, very many different
pieces. Tasks count different pieces while they scan; the windows of keys that have many are scanned once more
and keyed by further minima, of other hash functions, too: equal windows still have equal keys, the pieces get shorter, and those
inside the passage are equal in all documents and are counted as one. Which keys are taken as hot bears on the work alone.

Passages shorter than ``size`` can be counted beside the removal, in the same sort: windows are then keyed by their first ``passage``
bytes, and pieces carry the ``size`` - 1 bytes after their last start, as far as the text has them. Two windows of ``size`` bytes that are equal begin
with equal ones of ``passage`` bytes, so they meet as well, and common prefixes of window starts tell both.

Defined cases: a null text is empty; a text under ``size`` bytes loses nothing; repeated rows repeat each
other's windows, so both lose them; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .runtime import PACKED_BYTES, RID, blocks, bytes_of, join_packed, keep, lists, merged, pack, unpack, with_rid
from .suffix import permuted_prefixes, suffix_array

SIZE = 400
#: Bytes that passages of over 50 words seldom stay under; the query counts what repeats of this length and removes nothing by it.
PASSAGE = 280
ANCHOR = 64
#: Most windows of one piece.
LONGEST = 2048
#: Different pieces from which a key is dealt by one more minimum, and by one more for each doubling, up to DEEPEST; the least
#: of them that a task tells, the runs it holds to count them, and the most keys that are dealt further (4 MB go to the tasks).
HOT, DEEPEST, LOCAL, HELD, MOST_HOT = 128, 6, 3, 1 << 18, 1 << 18
#: Bytes of text from which a shard is sorted; one key's pieces stay together.
SHARD_BYTES = 1 << 19

#: Runs of documents; and, without rid, numbers of different pieces (digest) of a key.
RUNS = "key long, digest long, rid binary, first int, count int, again boolean"


def _runs(data: np.ndarray, offsets: np.ndarray, size: int, minima: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first start and number of starts of each piece: equal minima, one text, not too long."""
    n = len(minima)
    valid = np.zeros(n + 1, np.int8)
    length = np.diff(offsets)
    has = np.flatnonzero(length >= size)
    np.add.at(valid, offsets[has], 1)
    np.add.at(valid, offsets[has] + length[has] - size + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    edge = np.zeros(n + 1, bool)
    edge[offsets[has]] = True
    new = np.flatnonzero(valid & (edge[:n] | np.concatenate([[True], (minima[1:] != minima[:-1]) | ~valid[:-1]])))
    if not len(new):
        none = np.zeros(0, np.int64)
        return none, none, none
    doc = np.searchsorted(offsets, new, "right") - 1
    stop = np.minimum(np.concatenate([new[1:], [n]]), offsets[doc] + length[doc] - size + 1)
    parts = -(-(stop - new) // LONGEST)
    if parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        doc, new, stop = (np.repeat(x, parts) for x in (doc, new, stop))
        new = new + k * LONGEST
        stop = np.minimum(stop, new + LONGEST)
    return doc, new, stop - new


def _different(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate([np.stack(h, axis=1) for h in held]), axis=0)
    keys, n = np.unique(pairs[:, 0], return_counts=True)
    keys, n = keys[n >= LOCAL], n[n >= LOCAL]
    none = pa.nulls(len(keys), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(len(keys), pa.binary()), none, none, pa.nulls(len(keys), pa.bool_())], ["key", "digest", "rid", "first", "count", "again"])


def _further_minima(hashes: np.ndarray, minima: np.ndarray, depth: np.ndarray, width: int) -> np.ndarray:
    """The minima, mixed with those of as many other hash functions as ``depth`` says; only hashes of such windows are looked at."""
    edge = np.diff((depth > 0).astype(np.int8), prepend=0, append=0)
    near = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(near, np.flatnonzero(edge == 1), 1)
    np.add.at(near, np.flatnonzero(edge == -1) + width - 1, -1)
    near = np.cumsum(near)[:-1] > 0
    at = np.flatnonzero(depth)
    place, deep, few = (np.cumsum(near) - 1)[at], depth[at], hashes[near]
    out = minima.copy()
    for k in range(1, int(deep.max()) + 1):
        on = deep >= k
        out[at[on]] = B.mix(out[at[on]] ^ B.sliding_min(B.mix(few, 100 + k), width)[place[on]], 13)
    return out


def _scan(size: int, shared=None, reach: int = 0):
    """Runs of all windows; with ``shared`` (hot keys in order, and how deep each is dealt) those of the hot keys' windows, by further minima.

    Digests are of pieces with ``reach`` bytes from their last start on, as far as the text goes, if that is more than ``size``.
    """
    reach = max(size, reach)

    def scan(batches):
        hot, depths = shared.value if shared else (None, None)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offsets = bytes_of(part.column(1))
                if len(data) < size:
                    continue
                hashes = B.rolling(data, ANCHOR)
                minima = B.sliding_min(hashes, size - ANCHOR + 1)
                keys = minima
                if shared:
                    at = np.minimum(np.searchsorted(hot, minima), len(hot) - 1)
                    depth = np.where(hot[at] == minima, depths[at], 0)
                    if not depth.any():
                        continue
                    keys = _further_minima(hashes, minima, depth, size - ANCHOR + 1)
                doc, first, count = _runs(data, offsets, size, keys)
                if shared:
                    own = depth[first] > 0
                    doc, first, count = doc[own], first[own], count[own]
                if not len(first):
                    continue
                key, anchor = keys[first], minima[first]
                digest = B.SpanHash(data)(first, np.minimum(first + count + reach - 1, offsets[doc + 1]))
                # Places of the smallest hash inside each piece: two or more, and the piece may repeat itself.
                names, own_name = np.unique(anchor, return_inverse=True)
                place = np.searchsorted(names, hashes)
                place[place == len(names)] = 0
                spots = np.flatnonzero(names[place] == hashes)
                pairs = np.sort(place[spots] * np.int64(len(hashes)) + spots)
                low = own_name * np.int64(len(hashes)) + first
                inside = np.searchsorted(pairs, low + count + size - ANCHOR) - np.searchsorted(pairs, low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), part.column(0).take(pa.array(doc)), pa.array((first - offsets[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(inside > 1)],
                    ["key", "digest", "rid", "first", "count", "again"],
                )
                if not shared:
                    held.append((key, digest))
                    if sum(len(h[0]) for h in held) >= HELD:
                        yield _different(held)
                        held = []
        if held:
            yield _different(held)

    return scan


PIECES = "key long, digest long, count int, many boolean, piece binary"


def _cut(reach: int):
    """Pieces of the documents' runs; a text that ends before ``reach`` ends them."""

    def cut(batches):
        for batch in (part for whole in batches for part in blocks(whole, "text", PACKED_BYTES)):
            texts, runs = unpack(batch.column("text")), batch.column("runs")
            out: list[tuple] = []
            for text, own in zip(texts, runs):
                raw = memoryview(text.as_buffer())
                for r in own.as_py():
                    out.append((r["key"], r["digest"], r["count"], r["w"] > 1, bytes(raw[r["first"] : r["first"] + r["count"] + reach - 1])))
                    if len(out) >= 1024:
                        yield _pieces(out)
                        out = []
            if out:
                yield _pieces(out)

    return cut


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "digest", "count", "many", "piece"])


FOUND = "key long, digest long, starts array<int>, ends array<int>, near_starts array<int>, near_ends array<int>"


def shard_repeats(pieces: list[bytes], counts: np.ndarray, many: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Which windows of a shard's pieces, end to end, repeat in each of the sizes: from its suffix array and common prefixes."""
    data = np.frombuffer(b"\xff".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    first = np.cumsum(lengths + 1) - lengths - 1
    order = suffix_array(data)
    _, prefix = permuted_prefixes(data, order)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.repeat(first, counts) + inside
    # A piece's last bytes begin the next piece of its text, so only starts of windows are held against each other.
    own = np.zeros(len(data), bool)
    own[window] = True
    places = np.flatnonzero(own[order])
    shared = np.zeros(len(places) + 1, np.int32)
    if len(places) > 1:
        shared[1:-1] = np.minimum.reduceat(prefix[order[: places[-1] + 1]], places[:-1] + 1)
    best = np.zeros(len(data), np.int32)
    best[order[places]] = np.maximum(shared[:-1], shared[1:])
    rest, copied = np.repeat(lengths, counts) - inside, np.repeat(many, counts)
    return [((best[window] >= size) | copied) & (rest >= size) for size in sizes]


def _sort_shards(size: int, passage: int):
    def sort(batches):
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            while batch.num_rows:
                shard = np.asarray(batch.column("key"))
                if weight >= SHARD_BYTES:
                    same = len(shard) if shard[-1] == (last := held[-1].column("key")[-1].as_py()) else int(np.argmax(shard != last))
                    if same:
                        held.append(batch.slice(0, same))
                        batch = batch.slice(same)
                        if not batch.num_rows:
                            break
                    yield from _shard(held, size, passage)
                    held, weight = [], 0
                lengths = np.diff(bytes_of(batch.column("piece"))[1])
                take = int(np.searchsorted(np.cumsum(lengths), SHARD_BYTES)) + 1
                held.append(batch.slice(0, take))
                weight += int(lengths[:take].sum())
                batch = batch.slice(take)
        if held:
            yield from _shard(held, size, passage)

    return sort


def _stretches(hit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Piece, first and end of each stretch of repeated windows, half-open, counted from the piece's first."""
    base = np.cumsum(counts) - counts
    flags = np.concatenate([[0], hit.astype(np.int8), [0]])
    edge = np.zeros(len(hit) + 1, bool)
    edge[base] = True
    up = np.flatnonzero(hit & ((flags[:-2] == 0) | edge[:-1]))
    down = np.flatnonzero(hit & ((flags[2:] == 0) | edge[1:])) + 1
    of = np.repeat(np.arange(len(counts)), counts)[up]
    return of, (up - base[of]).astype(np.int32), (down - base[of]).astype(np.int32)


def _shard(held: list[pa.RecordBatch], size: int, passage: int):
    t = pa.Table.from_batches(held)
    counts = t["count"].to_numpy().astype(np.int64)
    sizes = (size, passage) if passage else (size,)
    hits = shard_repeats([x.as_buffer() for x in t["piece"]], counts, t["many"].to_numpy(), sizes)
    found = [_stretches(hit, counts) for hit in hits]
    rows = np.unique(np.concatenate([of for of, _, _ in found]))
    if not len(rows):
        return
    columns = [lists(np.split(x, np.searchsorted(of, rows[1:])), pa.int32()) for of, *ends in found for x in ends]
    columns += [lists([np.zeros(0, np.int32)] * len(rows), pa.int32())] * (4 - len(columns))
    yield pa.RecordBatch.from_arrays(
        [pa.array(t["key"].to_numpy()[rows]), pa.array(t["digest"].to_numpy()[rows]), *columns],
        ["key", "digest", "starts", "ends", "near_starts", "near_ends"],
    )


def _dealt_texts(docs: DataFrame) -> DataFrame:
    """doc_id, rid and the packed text. Both joins with texts read these very columns, so that the texts are dealt out once."""
    whole = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    whole = whole.select("doc_id", F.col(RID).alias("rid"), F.col("text").cast("binary").alias("text"))
    return pack(whole).filter("rid is not null")


def repeated_spans(docs: DataFrame, size: int = SIZE, passage: int = 0) -> DataFrame:
    """Columns rid (as with_rid gives of doc_id as a long), starts, ends: lists of the repeated windows' starts, half-open, in bytes.

    near_starts and near_ends are those of windows of ``passage`` bytes; without a passage they are empty.
    """
    if passage and not ANCHOR <= passage <= size:
        raise ValueError(f"a passage has {ANCHOR} to {size} bytes")
    least = passage or size
    long = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).filter(F.octet_length("text") >= least).select(RID, F.col("text").cast("binary").alias("text"))
    scanned = keep(long.mapInArrow(_scan(least, reach=size), RUNS), "runs")
    runs = scanned.filter("rid is not null")
    counts = scanned.filter("rid is null").groupBy("key").agg(F.sum("digest").alias("n")).filter(F.col("n") >= HOT)
    hot = {r.key: r.n for r in counts.orderBy(F.col("n").desc(), "key").limit(MOST_HOT).collect()}
    if hot:
        keys = np.sort(np.array(list(hot), np.int64).view(np.uint64))
        depths = np.minimum(DEEPEST, 1 + np.log2([hot[int(k)] / HOT for k in keys.view(np.int64)]).astype(np.int64))
        shared = docs.sparkSession.sparkContext.broadcast((keys, depths))
        deeper = keep(long.mapInArrow(_scan(least, shared, size), RUNS), "hot-runs")
        own = docs.sparkSession.createDataFrame([(k,) for k in hot], "key long")
        runs = runs.join(F.broadcast(own), "key", "left_anti").unionByName(deeper)  # MOST_HOT rows at most
    # Most keys stand once: their runs are dealt out by key this once, and all further steps have the others alone.
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.max("again").alias("again")).filter("total > 1 or again").select("key")
    runs = keep(runs.drop("again").join(keys, "key", "left_semi"), "repeated-runs")
    # Pieces of the same bytes and key have as many windows, even if a text's end cuts one of them: windows are keyed by their own bytes.
    wanted = runs.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct("rid", "first", "count")).alias("at"))
    by_doc = wanted.groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(F.struct("key", "digest", "at.first", "at.count", "w")).alias("runs"))
    cut = join_packed(_dealt_texts(docs), by_doc, key="rid").select("doc_id", "text", "runs").mapInArrow(_cut(size), PIECES)
    found = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shards(size, passage), FOUND)
    sides = ["starts", "ends", "near_starts", "near_ends"]
    joined = [F.flatten(F.collect_list(c)).alias(c) for c in sides]
    found = found.groupBy("key", "digest").agg(*joined)
    spots = runs.select("key", "digest", "rid", "first").join(found, ["key", "digest"])
    return spots.select("rid", *[F.expr(f"transform({c}, x -> x + first)").alias(c) for c in sides]).groupBy("rid").agg(*joined)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, removed array<struct<start:long,stop:long>>, kept binary"


def _spans(part: pa.RecordBatch, row: int, names: tuple[str, str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that windows of ``size`` cover, from the lists of their starts."""
    a, b = (part.column(n)[row] for n in names)
    if not a.is_valid:
        return merged(np.zeros(0, np.int64), np.zeros(0, np.int64))
    return merged(np.asarray(a.values).astype(np.int64), np.asarray(b.values).astype(np.int64) + size - 1)


def _strip(size: int, passage: int, full: bool):
    def strip(batches):
        for batch in batches:
            for part in blocks(batch, "text", PACKED_BYTES):
                data, offsets = bytes_of(unpack(part.column("text")))
                cols: list[list] = [[] for _ in range(8)]
                for k in range(part.num_rows):
                    raw = data[offsets[k] : offsets[k + 1]]
                    a, b = _spans(part, k, ("starts", "ends"), size)
                    near = _spans(part, k, ("near_starts", "near_ends"), passage)
                    keep_mask = np.ones(len(raw), bool)
                    for x, y in zip(a, b):
                        keep_mask[x:y] = False
                    kept = raw[keep_mask].tobytes()
                    row = (part.column("doc_id")[k].as_py(), len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), int((near[1] - near[0]).sum()) if passage else None, [{"start": int(x), "stop": int(y)} for x, y in zip(a, b)], kept if full else None)
                    for c, v in zip(cols, row):
                        c.append(v)
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), span, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "removed", "kept"])

    return strip


def exact_substring_dedup(docs: DataFrame, size: int = SIZE, with_bytes: bool = True, passage: int = 0) -> DataFrame:
    """Per document the spans removed and, if asked for, the bytes that stay (they need not be valid UTF-8).

    With a ``passage`` of fewer bytes than ``size``, n_repeated is the number of bytes in strings of that length that also start
    elsewhere; they are counted, not removed. Without one it is null.
    """
    spans = repeated_spans(docs, size, passage)
    return join_packed(_dealt_texts(docs), spans, "left", "rid").select("doc_id", "text", "starts", "ends", "near_starts", "near_ends").mapInArrow(_strip(size, passage, with_bytes), OUT)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    from .runtime import table

    out = exact_substring_dedup(table(spark, sf_dir, "documents"), with_bytes=False, passage=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
