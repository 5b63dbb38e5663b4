"""Op 6: exact Jaccard join of word shingles by parity sketches.

A document's set is its distinct shingles of ``SHINGLE`` words. Equal sets are one class from the start. Two sets
link when their intersection is at least 3/4 of their union; then their sizes are within 3 to 4, and they differ
in at most a seventh of the sum of their sizes.

Candidates. A class takes part in the size band of its own size, and in the one below if a partner can be there.
In a band every shingle falls in one of P parts, and a part's sketch is the parity of its shingles over a very wide
row of bits, of which the XOR of one random word for each shingle is the fingerprint. P exceeds the most
differences, so two sets that link have a part alike. Empty parts, and parts of nothing but very frequent shingles (a
line or passage that countless documents share), tell nothing. A part of frequent shingles is dealt out only by a set of which
the other parts do not exceed its differences, since any other set meets its partners in a part that tells something; an
empty part only by a set whose parts with anything in them do not either; and a set that can differ from no partner deals
nothing, as equal sets are one class already. Which shingles are
taken as frequent, from counts over all documents, bears on the work alone, never on the result. Part sketches of a block of documents travel packed, one row for
each bucket.

Why one XOR word is the bit sketch of a part: a row of 2^64 bits, of which each shingle flips the one that its hash
names, is empty wherever no shingle fell, and two rows are equal when their shingles of odd count are the same; the XOR of the
names of the flipped bits is equal then too, and differs otherwise but for a chance of 2^-40. A row so wide has the
fewest equal parts by accident, and in this form it takes 5 bytes. Narrow rows, whose Hamming distance
counts, come after: ``parity_sketch`` has one to two bits a shingle, and 256 at least.

Classes are named by 64 bits. Where a second digest shows that two classes have one name, which 10^10 classes
would see a few times, both get names that the second digest is part of.

Verification. Classes that share part sketches form groups, which are compared in blocks, by sizes and by the Hamming
distance of parity sketches (it never exceeds the true difference). First each class takes its closest few;
what links set by set is joined into components. Then all pairs of different components that the sketches leave possible
are compared set by set. Pairs inside a component need no look, so large groups of copies cost little, and no link
between components is lost.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; repeated rows are in one
class; an empty table gives no rows; long texts are read whole; extra columns, of any name, pass through
``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .components import components
from .runtime import PACKED_BYTES, RID, blocks, bytes_of, join_packed, keep, lists, pack, shielded, table, unpack, with_rid

SHINGLE = 5
#: Bytes of text for each bucket of part sketches.
BUCKET_BYTES = 12 << 20
#: Part sketches of a task that travel together.
TOGETHER = 1 << 20
#: Classes of a group that one task compares to each other.
GROUP_BLOCK = 1024
#: Closest classes that each one is compared to at first, and groups that a class names for telling pairs apart.
NEAREST, NAMED = 2, 8
#: Classes of a group in one row.
MEMBERS = 4096
NO_CLASSES = np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's start."""
    low = B.LOWER[data]
    words = B.Words(low, offsets, B.SPACED)
    hashes = B.SpanHash(low)(words.start, words.end)
    counts = np.diff(words.first)
    grams = B.gram_hashes(hashes, size)
    at = np.flatnonzero(B.window_starts(words.first, size)[: len(grams)])
    value, doc = [grams[at]], [words.doc[at]]
    for n in range(1, size):  # texts of fewer words: all of them, marked by their number
        short = np.flatnonzero(counts == n)
        value.append(B.mix(B.gram_hashes(hashes, n)[words.first[short]], 50 + n) if len(short) else np.zeros(0, np.uint64))
        doc.append(short)
    value, doc = np.concatenate(value), np.concatenate(doc)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])[: len(value)]
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def _folded(ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """ufunc over each text's values; 0 for a text without any."""
    out = np.zeros(len(first) - 1, values.dtype)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        out[has] = ufunc.reduceat(values, first[has])
    return out


def class_keys(value: np.ndarray, first: np.ndarray, taken: np.ndarray = NO_CLASSES, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set: the second is the class's name, both together tell sets apart; ``taken``: names of several classes."""
    a = _folded(np.add, B.mix(value, 61), first)
    b = _folded(np.bitwise_xor, B.mix(value, 62), first)
    return a, renamed(a, B.mix(a ^ B.mix(b, 63) ^ np.diff(first).astype(np.uint64), 64) >> np.uint64(64 - bits), taken)


def renamed(a: np.ndarray, cid: np.ndarray, taken: np.ndarray) -> np.ndarray:
    return np.where(np.isin(cid, taken), B.mix(cid ^ B.mix(a, 65), 66), cid) if len(taken) else cid


def most_differences(a):
    """Most elements in which a set of ``a`` can differ from a linked set that is no smaller."""
    return (a + 4 * a // 3) // 7


def band_of(size: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(size, 1)).astype(np.int64)


def parts_of(band: int) -> int:
    low = 1 << band
    return most_differences(2 * low - 1) + 1 + int(0.14 * low + 2 * low**0.5)


def part_sketches(value: np.ndarray, first: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of part sketches, with band and part mixed in, and the set of each.

    A part tells something if it has a shingle that is not frequent. Of a set with more such parts than differences one is
    alike in each partner, and these suffice; else its parts of frequent shingles count too; else, rarely, the empty ones.
    """
    size = np.diff(first)
    band = band_of(size)
    words, out, owner = B.mix(value, 71), [], []
    place = np.minimum(np.searchsorted(frequent, value), max(len(frequent) - 1, 0))
    rare = frequent[place] != value if len(frequent) else np.ones(len(value), bool)
    for b in np.unique(band[size > 0]):
        for config in (b, b - 1):
            if config < 0:
                continue
            low = 1 << config
            sets = np.flatnonzero((size > 0) & (band == b) & ((config == b) | (3 * size <= 4 * (2 * low - 1))))
            # As the larger of a pair, a set's partner here is under 2 * low.
            differ = np.where(size[sets] < 2 * low, most_differences(size[sets]), (size[sets] + 2 * low - 1) // 7)
            sets, differ = sets[differ > 0], differ[differ > 0]
            if not len(sets):
                continue
            parts = parts_of(int(config))
            n = size[sets]
            own = np.repeat(np.arange(len(sets)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[sets], n)
            part = (((value[at] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            cell = own * parts + part
            print_ = np.zeros(len(sets) * parts, np.uint64)
            np.bitwise_xor.at(print_, cell, words[at])
            used = np.bincount(cell[rare[at]], minlength=len(print_)) > 0
            filled = np.bincount(cell, minlength=len(print_)) > 0
            short, bare = (np.repeat(x.reshape(-1, parts).sum(axis=1) <= differ, parts) for x in (used, filled))
            deal = np.flatnonzero(used | short & filled | bare)
            out.append(B.mix(print_[deal] ^ B.mix((deal % parts + (int(config) << 40)).astype(np.uint64), 72), 73))
            owner.append(sets[deal // parts])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def parity_sketch(values: np.ndarray) -> np.ndarray:
    """Bits whose parities tell how many of the set's shingles fall there: 1 to 2 for each shingle, 256 at least."""
    bits = 1 << max(8, int(band_of(np.array([len(values)]))[0]) + 1)
    odd = np.bincount((B.mix(values, 81) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def narrowed(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) folded to fewer words: still parities, of wider places."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


#: Shingles that a task holds to find frequent ones, the least count of such a one there, and in all.
HELD, LOCAL, FREQUENT = 1 << 20, 8, 32
#: Most frequent shingles that go to the tasks (2 MB). Any set of them gives right results.
MOST_FREQUENT = 1 << 18

#: Rows of documents; and, with no class, counts n of a shingle a.
SETS = "doc_id long, rid binary, n long, a long, cid long"


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    values, counts = values[counts >= LOCAL], counts[counts >= LOCAL]
    none = pa.nulls(len(values), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.nulls(len(values), pa.binary()), pa.array(counts, pa.int64()), pa.array(values.view(np.int64)), none], ["doc_id", "rid", "n", "a", "cid"])


def _sets(bits: int):
    def sets(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for part in blocks(batch, "text"):
                value, first = shingle_sets(*bytes_of(part.column("text")))
                a, cid = class_keys(value, first, bits=bits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(RID), pa.array(np.diff(first)), pa.array(a.view(np.int64)), pa.array(cid.view(np.int64))], ["doc_id", "rid", "n", "a", "cid"])
                held.append(value)
                if sum(map(len, held)) >= HELD:
                    yield _counted(held)
                    held = []
        if held:
            yield _counted(held)

    return sets


def _told_apart(taken: np.ndarray):
    def told_apart(batches):
        for batch in batches:
            a, cid = (np.asarray(batch.column(c)).view(np.uint64) for c in ("a", "cid"))
            yield batch.set_column(4, "cid", pa.array(renamed(a, cid, taken).view(np.int64)))

    return told_apart


def _classes(sets: DataFrame) -> DataFrame:
    """cid, its first document, and the least and the most of the second digest."""
    found = sets.filter("n > 0").groupBy("cid").agg(F.min(F.struct("doc_id", "rid")).alias("lead"), F.min("a").alias("low"), F.max("a").alias("high"))
    return keep(found, "classes")


PACKED = "bucket int, classes binary, prints binary, upper binary, owners binary"


def _dealt(buckets: int, shared, taken: np.ndarray, bits: int):
    def emit(prints, owners, classes):
        prints, owners, classes = np.concatenate(prints), np.concatenate(owners), np.concatenate(classes)
        bucket = (((prints >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[b] : cuts[b + 1]]
            here, index = np.unique(owners[own], return_inverse=True)
            rows.append((int(b), classes[here].tobytes(), prints[own].astype(np.uint32).tobytes(), (prints[own] >> np.uint64(32)).astype(np.uint8).tobytes(), index.astype(np.uint16 if len(here) < 1 << 16 else np.uint32).tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "classes", "prints", "upper", "owners"])

    def dealt(batches):
        prints, owners, classes, held, known = [], [], [], 0, 0
        for batch in batches:
            for part in blocks(batch, "text"):
                value, first = shingle_sets(*bytes_of(part.column("text")))
                _, cid = class_keys(value, first, taken, bits)
                _, one = np.unique(cid, return_index=True)
                one = np.sort(one[np.diff(first)[one] > 0])  # copies of a text in the block are one class
                if not len(one):
                    continue
                n = np.diff(first)[one]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[one], n)
                p, o = part_sketches(value[at], np.concatenate([[0], np.cumsum(n)]), shared.value)
                prints.append(p)
                owners.append(o + known)
                classes.append(cid[one])
                known += len(one)
                held += len(p)
                if held >= TOGETHER:
                    yield emit(prints, owners, classes)
                    prints, owners, classes, held, known = [], [], [], 0, 0
        if held:
            yield emit(prints, owners, classes)

    return dealt


GROUPS = "gid long, part int, members array<long>"


def _groups(batches):
    held: list[tuple] = []
    last = None
    for batch in batches:
        for bucket, *packed in zip(*(batch.column(k) for k in range(5))):
            if bucket.as_py() != last and held:
                yield _grouped(held)
                held = []
            last = bucket.as_py()
            held.append(tuple(bytes(x.as_buffer()) for x in packed))
    if held:
        yield _grouped(held)


def _grouped(held: list[tuple]) -> pa.RecordBatch:
    """Sets of two or more classes that share a part sketch, equal sets once, in rows of MEMBERS at most."""
    cids, prints = [], []
    for classes, p, u, o in held:
        p = np.frombuffer(p, np.uint32).astype(np.int64) | np.frombuffer(u, np.uint8).astype(np.int64) << 32
        own = np.frombuffer(o, np.uint16 if len(o) == 2 * len(p) else np.uint32)
        cids.append(np.frombuffer(classes, np.int64)[own])
        prints.append(p)
    cids, prints = np.concatenate(cids), np.concatenate(prints)
    order = np.argsort(prints)
    prints, cids = prints[order], cids[order]
    same = np.concatenate([[False], prints[1:] == prints[:-1], [False]])
    shared = same[:-1] | same[1:]
    prints, cids = prints[shared], cids[shared]
    order = np.lexsort((cids, prints))
    prints, cids = prints[order], cids[order]
    new = np.concatenate([[True], (prints[1:] != prints[:-1]) | (cids[1:] != cids[:-1])])[: len(cids)]
    prints, cids = prints[new], cids[new]
    start = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])[: len(cids)])
    size = np.diff(start, append=len(cids))
    some = size > 1
    start, size = start[some], size[some]
    if not len(start):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.int64()))], ["gid", "part", "members"])
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    gid = np.add.reduceat(B.mix(cids[at].view(np.uint64), 91), np.cumsum(size) - size)
    gid, one = np.unique(gid, return_index=True)
    start, size = start[one], size[one]
    parts = -(-size // MEMBERS)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.repeat(start, parts) + part * MEMBERS
    high = np.minimum(low + MEMBERS, np.repeat(start + size, parts))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(gid, parts).view(np.int64)), pa.array(part.astype(np.int32)), lists([cids[x:y] for x, y in zip(low, high)])], ["gid", "part", "members"])


def _chosen(batches):
    """Size and sketch of each class beside its packed text, which is a quarter of its set's size."""
    for batch in batches:
        for part in blocks(batch, "text", PACKED_BYTES):
            value, first = shingle_sets(*bytes_of(unpack(part.column("text"))))
            sketches = [parity_sketch(value[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(np.diff(first)), pa.array(sketches, pa.binary()), part.column("text")], ["cid", "n", "sketch", "text"])


def _linked(batches):
    for batch in batches:
        for part in blocks(batch, "ytext", PACKED_BYTES):
            (x, xf), (y, yf) = (shingle_sets(*bytes_of(unpack(part.column(c)))) for c in ("xtext", "ytext"))
            stay = []
            for k in range(part.num_rows):
                both = np.concatenate([x[xf[k] : xf[k + 1]], y[yf[k] : yf[k + 1]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= 75 * (len(both) - common):
                    stay.append(k)
            yield part.select(["x", "y"]).take(pa.array(stay, pa.int64()))


def verified(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those of the pairs (x, y) that link, by their whole sets."""
    slim = chosen.select("cid", "n", "text")
    full = pairs.join(slim.toDF("y", "yn", "ytext"), "y").join(slim.toDF("x", "xn", "xtext"), "x")
    return full.filter(3 * F.greatest("xn", "yn") <= 4 * F.least("xn", "yn")).select("x", "y", "xtext", "ytext").mapInArrow(_linked, "x long, y long")


KEY = ["gid", "low", "high"]
MET = "x long, y long, far int"


def _met(nearest: int | None):
    """Pairs of different components in a group (a pair of its blocks) whose sizes and sketches leave a link possible.

    With ``nearest``, each class takes that many of the closest only. Without, a pair that shares several of the
    groups that its classes name is given in the first of them alone.
    """

    def met(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY)))
            cut = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a == b:
                    continue
                if keys[a] != last and held:
                    yield from _pairs_of(held, nearest)
                    held = []
                last = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _pairs_of(held, nearest)

    return met


def _pairs_of(held: list[pa.RecordBatch], nearest: int | None):
    t = pa.Table.from_batches(held)
    cid, root, n, block = (t[c].to_numpy() for c in ("cid", "root", "n", "block"))
    if len(cid) < 2 or (root == root[0]).all():
        return
    crossed, gid = t["low"][0].as_py() != t["high"][0].as_py(), t["gid"][0].as_py()
    raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["sketch"]]
    words = min(map(len, raw))
    sketches = np.stack([narrowed(r[None], words)[0] for r in raw])
    named = t["named"].to_pylist() if nearest is None else None
    xs, ys, fs = [], [], []
    for i in range(len(cid)):
        rest = np.arange(len(cid)) if nearest else np.arange(i + 1, len(cid))
        ok = (root[rest] != root[i]) & (3 * np.maximum(n[rest], n[i]) <= 4 * np.minimum(n[rest], n[i]))
        if crossed:
            ok &= block[rest] != block[i]
        rest = rest[ok]
        if not len(rest):
            continue
        far = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1)
        near = far <= (n[rest] + n[i]) // 7
        rest, far = rest[near], far[near]
        if nearest:
            first = np.argsort(far, kind="stable")[:nearest]
            rest, far = rest[first], far[first]
        for j, f in zip(rest, far):
            if named is not None:
                both = set(named[i]).intersection(named[j])
                if both and min(both) != gid:
                    continue
            xs.append(cid[i])
            ys.append(cid[j])
            fs.append(f)
    if xs:
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(fs, pa.int32())], ["x", "y", "far"])


def met_pairs(groups: DataFrame, roots: DataFrame | None, chosen: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs (x, y) of classes that share a group, are not in one component, and may link."""
    members = groups.select("gid", F.explode("members").alias("cid"))
    if roots is None:
        members = members.withColumn("root", F.col("cid"))
    else:
        members = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = members.groupBy("gid").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("of")).filter("r != s")
    open_ = members.join(mixed.select("gid", F.ceil(F.col("of") / GROUP_BLOCK).cast("int").alias("blocks")), "gid")
    slim = chosen.select("cid", "n", "sketch")
    if nearest is None:
        # As many as a class has part sketches; a few of them tell most pairs' first common group.
        first = open_.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("gid")), 1, NAMED).alias("named"))
        slim = slim.join(first, "cid")
    else:
        slim = slim.withColumn("named", F.lit(None).cast("array<long>"))
    rows = open_.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("gid", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "cid", "root", "block").join(slim, "cid")
    met = rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_met(nearest), MET)
    if nearest:  # of what a class took in its groups, the closest again
        closest = F.slice(F.array_sort(F.collect_set(F.struct("far", "y"))), 1, nearest)
        met = met.groupBy("x").agg(closest.alias("c")).select("x", F.explode("c.y").alias("y"))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def link_documents(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, __jj_rid (row key), n_shingles, component_id and leader (the row key of the component's first document).

    bits: of the classes' names, fewer only to test what happens when names clash.
    """
    texts = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scanned = keep(texts.mapInArrow(_sets(bits), SETS), "sets")
    sets = scanned.filter("cid is not null")
    classes = _classes(sets)
    taken = np.array([r.cid & (1 << 64) - 1 for r in classes.filter("low != high").select("cid").collect()], np.uint64)
    if len(taken):
        sets = keep(sets.mapInArrow(_told_apart(taken), SETS), "sets-apart")
        classes = _classes(sets)
    counts = scanned.filter("cid is null").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    often = np.array(sorted(r.a & (1 << 64) - 1 for r in counts.orderBy(F.col("n").desc(), "a").limit(MOST_FREQUENT).collect()), np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(often)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = texts.select("text").mapInArrow(_dealt(max(1, -(-total // BUCKET_BYTES)), shared, taken, bits), PACKED)
    groups = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups, GROUPS)
    groups = keep(groups.groupBy("gid", "part").agg(F.any_value("members").alias("members")), "groups")
    needed = groups.select(F.explode("members").alias("cid")).distinct()
    wanted = needed.join(classes, "cid").select("cid", F.col("lead.rid").alias(RID))
    whole = pack(texts.select(RID, F.col("text").cast("binary").alias("text")))
    chosen = join_packed(whole, wanted).select("cid", "text").mapInArrow(_chosen, "cid long, n long, sketch binary, text binary")
    chosen = keep(chosen, "chosen")
    links = keep(verified(met_pairs(groups, None, chosen, NEAREST), chosen), "near-links")
    roots = keep(components(links), "roots")
    links = links.union(keep(verified(met_pairs(groups, roots, chosen, None), chosen), "cross-links"))
    roots = components(links)
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "lead", F.coalesce("root", "cid").alias("root"))
    heads = named.groupBy("root").agg(F.min("lead").alias("head"))
    named = keep(named.join(heads, "root").select("cid", "head"), "named")
    out = sets.join(named, "cid", "left")
    own = F.struct("doc_id", "rid")
    return out.select("doc_id", F.col("rid").alias("__jj_rid"), F.col("n").alias("n_shingles"), F.coalesce("head", own).alias("head")).select("doc_id", "__jj_rid", "n_shingles", F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("leader"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of linked ones: the one of the lowest doc_id."""
    from pyspark.sql import Window

    safe, names = shielded(docs, "doc_id", "text")
    firsts = link_documents(safe).filter(F.col("leader") == F.col("__jj_rid")).groupBy(F.col("__jj_rid").alias(RID))
    stay = keep(firsts.agg((F.count(F.lit(1)) > 1).alias("__jj_many")), "stay")
    kept = with_rid(safe).join(stay, RID)
    if not stay.filter("__jj_many").isEmpty():  # only repeated rows (same id and text) need to be compared
        once = F.row_number().over(Window.partitionBy(RID).orderBy(RID))
        again = kept.filter("__jj_many").withColumn("__jj_once", once).filter("__jj_once = 1").drop("__jj_once")
        kept = kept.filter("not __jj_many").unionByName(again)
    return kept.select(names).toDF(*docs.columns)


def op6_parity_sketch_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = {
    "op6_parity_sketch_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id)
  JOIN n n1 ON x = n1.doc_id JOIN n n2 ON y = n2.doc_id WHERE 100 * shared >= 75 * (n1.n + n2.n - shared)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON d.doc_id = r.x
"""
}
