"""Op 11: maximal periodic runs of words, from longest previous factors.

The texts of a block are numbered word by word, with numbers of their own for each text, so that one suffix array over
the block is the suffix arrays of its texts one after the other and no match leaves its text. From the array and its
common prefixes follow, per position, the longest previous factor and a place where it stands; they cut each text into
LZ blocks. A run that meets a border between two LZ blocks is found there by Main's extensions: for each period that can
reach so far, how long the words around the border stay equal at that distance (Z functions, in time linear in the two
blocks). A run strictly inside an LZ block stands at the block's earlier place too, and is copied from there out of
buckets by start, in rising order.

A run has length >= max(least, power * period). As its start is less than one period before the previous LZ block, only
periods under the sum of both blocks' lengths over (power - 1) can meet a border, and one of its two sides holds two equal pairs of
words at the border; borders and periods without such pairs are not extended.

Defined cases: a null text has no words, no runs, and collapses to an empty text; a text of fewer than ``least`` words has
no runs; equal rows give equal results; an empty table gives no rows; a text is worked on whole, in memory in
proportion to its words; extra columns, of any name, pass through, but for those of the operator's own names. In the
query, a null doc_id counts as an empty number.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import let
from .runtime import blocks, shielded, table
from .suffix import common_prefixes, suffix_array

LEAST, POWER = 6, 4
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 22
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
OUTPUT = [T.StructField("__pr_runs", T.ArrayType(RUN)), T.StructField("__pr_collapsed", T.StringType())]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_numbers(text: bytes, base: int) -> tuple[list[int], list[bytes]]:
    """Numbers from ``base`` on of the words of a text, in order of appearance, and the words so numbered."""
    known: dict[bytes, int] = {}
    numbers: list[int] = []
    at = 0
    while at < len(text):
        stop = _SPACE.search(text, at + PIECE) if len(text) > at + PIECE else None
        end = stop.start() if stop else len(text)
        words = text[at:end].split()
        new = [w for w in dict.fromkeys(words) if w not in known] if known else dict.fromkeys(words)
        known.update(zip(new, range(base + len(known), base + len(known) + len(new))))
        numbers += map(known.__getitem__, words)
        at = end
    return numbers, list(known)


def previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest factor that also starts earlier, and one such start (-1: none).

    order is a suffix array, common[r] the common prefix of its entries r - 1 and r. The best earlier starts are the
    nearest entries on both sides that are smaller; a stack of rising positions meets each entry's two.
    """
    n = len(order)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    edges = np.flatnonzero(common == 0)
    sizes = np.diff(edges, append=n)
    two = edges[sizes == 2]
    a, b = order[two], order[two + 1]
    late = np.maximum(a, b)
    length[late], source[late] = common[two + 1], np.minimum(a, b)
    lengths, sources = length.tolist(), source.tolist()
    for first, size in zip(edges[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        places, shared = order[first : first + size].tolist(), common[first : first + size].tolist()
        places.append(-1)
        shared.append(0)
        # Each entry of the stack has its common prefix with the one below.
        stack, below = [-1], [0]
        top = -1
        for place, here in zip(places, shared):
            while top > place:
                stack.pop()
                under = below.pop()
                if under >= here:
                    lengths[top], sources[top] = under, stack[-1]
                else:
                    lengths[top], sources[top] = here, place
                    here = under
                top = stack[-1]
            stack.append(place)
            below.append(here)
            top = place
    return np.array(lengths, np.int64), np.array(sources, np.int64)


def lz_blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks and the end of the last one."""
    n = len(length)
    long = np.flatnonzero(length > 1)
    # Blocks of one word need no step of their own: from the end of a longer block to the next place of a longer one.
    following = np.searchsorted(long, long + length[long]).tolist()
    taken, k = [], 0
    while k < len(following):
        taken.append(k)
        k = following[k]
    inside = np.zeros(n + 2, np.int64)
    chosen = long[taken]
    inside[chosen + 1] += 1
    np.subtract.at(inside, chosen + length[chosen], 1)
    return np.flatnonzero(np.cumsum(inside)[: n + 1] == 0)


def _z(word: list[int]) -> list[int]:
    """At each place the length of the longest prefix of word that starts there."""
    n = len(word)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for k in range(1, n):
        size = min(right - k, z[k - left]) if k < right else 0
        while k + size < n and word[size] == word[k + size]:
            size += 1
        z[k] = size
        if k + size > right:
            left, right = k, k + size
    return z


def _borders(words: np.ndarray, cuts: np.ndarray, least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the borders that a run may meet, and the largest period to try at each."""
    sizes = np.diff(cuts)
    before, after = sizes, np.append(sizes[1:], 0)
    both = before + after
    short = (least - 1) // power  # up to this period a run needs ``least`` words
    enough = min(least - short + 1, (power - 1) * (short + 1) + 1)
    most = np.where(both >= enough, (both - 1) // (power - 1), 0)
    at = np.flatnonzero(most)
    found = []
    padded = np.concatenate([[-1, -1], words, [-2, -2]])  # a place k of words is k + 2 here
    for first in range(0, len(at), 1 << 14):
        own = at[first : first + (1 << 14)]
        reach = most[own]
        border = np.repeat(own, reach)
        period = np.arange(len(border)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
        s = cuts[border + 1] + 2
        ahead = np.minimum(s + period, len(words) + 2)
        behind = np.maximum(s - 1 - period, 1)
        pair = (padded[s] == padded[ahead]) & (padded[s + 1] == padded[ahead + 1])
        pair |= (padded[s - 1] == padded[behind]) & (padded[s - 2] == padded[behind - 1])
        found.append(np.unique(border[pair]))
    chosen = np.concatenate(found) if found else at[:0]
    return chosen, most[chosen]


def _around(words: list[int], s: int, before: int, after: int, periods: int, least: int, power: int):
    """Runs that start at or before the border s, end at or after it and within the block behind it: start, end, period."""
    n = len(words)
    v = words[s : s + after + 1]
    low = max(0, s - before - periods)
    t = words[low:s]
    back, size, past = t[::-1], len(v), len(t)
    periods = min(periods, max(past, size))
    # Forward: what stands at s against what stands p before and after it; backward the same, from s - 1 on.
    near = t[max(0, past - periods) :]
    forward = _z([*v, -1, *near, *v])
    over = v[:periods]
    backward = _z([*back, -1, *over[::-1], *back])
    for p in range(1, periods + 1):
        need = max(least, power * p)
        if p < size:
            right, left = forward[p], backward[past + 1 + len(over) - p] if p <= len(over) else 0
            a, b = s - left, s + p + right
            if b - a >= need and b <= s + after and (left < past or low == 0):
                yield a, b, p
        if p <= past:
            left, right = backward[p] if p < past else 0, forward[size + 1 + len(near) - p]
            right = min(right, size)
            a, b = s - p - left, s + right
            if b - a >= need and (right <= after or s + right == n) and (p + left < past or low == 0):
                yield a, b, p


def runs(words: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """Start, end and smallest period of every run, by start and period.

    Words are numbers; a run never spans places that share no number, so texts with numbers of their own may stand in a row.
    """
    if len(words) < least:
        return []
    order = suffix_array(words)
    length, source = previous_factors(order, common_prefixes(words, order))
    cuts = lz_blocks(length)
    chosen, periods = _borders(words, cuts, least, power)
    if not len(chosen):
        return []
    sizes = np.append(np.diff(cuts), 0).tolist()
    flat = words.tolist()
    found: dict[tuple[int, int], int] = {}
    for border, most in zip(chosen.tolist(), periods.tolist()):
        for a, b, p in _around(flat, int(cuts[border + 1]), sizes[border], sizes[border + 1], most, least, power):
            found[a, b] = min(p, found.get((a, b), p))
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (a, b), p in found.items():
        by_start.setdefault(a, []).append((b, p))
    for s in cuts[:-1][np.diff(cuts) >= least + 2].tolist():
        size, earlier = int(length[s]), int(source[s])
        for a in range(earlier + 1, earlier + size - least):
            for b, p in by_start.get(a, ()):
                if b < earlier + size:
                    by_start.setdefault(a + s - earlier, []).append((b + s - earlier, p))
    return sorted({(a, b, p) for a, ends in by_start.items() for b, p in ends}, key=lambda r: (r[0], r[2]))


def _collapsed(own: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words stay: a run's words after its first period go."""
    change = np.zeros(n + 1, np.int64)
    for a, b, p in own:
        change[a + p] += 1
        change[b] -= 1
    return np.cumsum(change)[:n] == 0


def _with_runs(names: list[str], least: int, power: int):
    def with_runs(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in blocks(batch, "text"):
                numbers, tables, offsets, base = [], [], [0], 0
                for text in part.column(at).cast(pa.binary()):
                    own, table_ = _word_numbers(text.as_py() or b"", base)
                    numbers.append(np.array(own, np.int64))
                    tables.append(table_)
                    offsets.append(offsets[-1] + len(own))
                    base += len(table_)
                found = runs(np.concatenate(numbers), least, power)
                held = np.searchsorted(np.array(offsets), np.array([a for a, _, _ in found], np.int64), "right") - 1
                by_text: list[list[tuple[int, int, int]]] = [[] for _ in numbers]
                for k, (a, b, p) in zip(held.tolist(), found):
                    by_text[k].append((a - offsets[k], b - offsets[k], p))
                texts, first = [], 0
                for own, spans, table_ in zip(numbers, by_text, tables):
                    stay = own[_collapsed(spans, len(own))] if spans else own
                    texts.append(b" ".join(map(table_.__getitem__, (stay - first).tolist())))
                    first += len(table_)
                listed = [[{"start": a, "length": b - a, "period": p} for a, b, p in spans] for spans in by_text]
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(listed, kind), pa.array(texts, pa.binary()).cast(pa.string())], names + [f.name for f in OUTPUT])

    return with_runs


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """The columns of docs, __pr_runs (start, length, period in words, by start and period) and __pr_collapsed.

    __pr_collapsed has the words, joined by spaces, that no run holds after its first period.
    """
    if power < 4 or least < 6:
        raise ValueError("runs of at least four periods and six words")
    added = [f.name for f in OUTPUT]
    docs = docs.drop(*added)
    safe, names = shielded(docs, "text")
    return safe.mapInArrow(_with_runs(names, least, power), T.StructType(safe.schema.fields + OUTPUT)).toDF(*docs.columns, *added)


def planted(docs: DataFrame) -> DataFrame:
    """docs in which one text of ten, by the CRC of its doc_id, repeats some of its own words from some place on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(own):
        n, g = F.size(own), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(F.transform(own, lambda w, i: F.when(i < a, w).otherwise(F.get(own, a + (i - a) % p))), " ")).otherwise("")

    return docs.withColumn("text", F.when(F.col("text").isNotNull() & (h % 10 == 0), let(words, repeated)).otherwise(F.col("text")))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs)
    each = F.transform("__pr_runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    # The greatest length first, then the smallest start and period.
    top = F.array_max(F.transform("__pr_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.select("doc_id", F.size("__pr_runs").cast("long").alias("n_runs"), top.alias("top"), F.array_join(each, "").alias("runs"), "__pr_collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("runs").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("__pr_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
