"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

Suffixes are classed as smaller (S) or larger (L) than their successor. Each position's segment runs to
the next leftmost-smaller (LMS) position; segments are named in order, the string of LMS names is sorted
recursively, and every suffix is then induced from the name of its segment and the rank of the LMS
suffix at its end.
"""

from __future__ import annotations

import numpy as np


def _places(words: np.ndarray) -> np.ndarray:
    """For each word its place in their order (the first place of equal ones)."""
    order = np.argsort(words)
    ordered = words[order]
    places = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])).astype(np.int32)
    del ordered
    rank = np.empty(len(words), np.int32)
    rank[order] = np.repeat(places, np.diff(places, append=np.int32(len(words))))
    return rank


def _segment_names(sym: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order-preserving names of sym[i : i + size[i]] for each i."""
    n, bits = len(sym), max(1, int(sym.max()).bit_length())
    per = max(1, 62 // bits)
    word = np.zeros(n, np.int64)
    for k in range(per):
        word <<= bits
        if k < n:
            word[: n - k] |= np.where(size[: n - k] > k, sym[k:], 0)
    rank = _places(word)
    del word
    done = per
    active = np.flatnonzero(size > done).astype(np.int32)
    alone = None
    while len(active):
        # One of a kind needs no more symbols. Equal starts that go on do so together: the types are in the symbols.
        counts = np.bincount(rank[active], minlength=n)
        active = active[counts[rank[active]] > 1]
        del counts
        if not len(active):
            break
        if alone is None:
            # A segment's last symbol starts a segment itself, but counts as a symbol alone.
            alone = _places(sym) if sym.max() > 4 * n else (np.cumsum(np.bincount(sym)) - np.bincount(sym)).astype(np.int32)[sym]
        old, ahead = rank[active], active + np.int32(done)
        word = old.astype(np.int64) << 31
        word |= np.where(size[active] == done + 1, alone[ahead], rank[ahead])
        rank[active] = old + _places(word) - _places(old)
        done *= 2
        active = active[size[active] > done]
    return rank


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of integers from 0 to 2 ** 30; a shorter suffix precedes a longer one that it starts."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    return _sorted_suffixes(np.concatenate([text.astype(np.int32) + np.int32(1), np.zeros(1, np.int32)]))[1:]


def _sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """text ends with 0, which is nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(text))  # over 0: S; under 0: L; 0: as the next
    decided = np.concatenate([np.flatnonzero(step), [n - 1]])
    kind = np.concatenate([step[decided[:-1]] > 0, [True]])
    smaller = np.repeat(kind, np.diff(decided, prepend=-1))
    del step, decided, kind
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + np.int32(1)
    # The next LMS position of each position; the end mark has none and is its own.
    after = np.cumsum(np.bincount(lms, minlength=n), dtype=np.int32)
    after[-1] -= 1
    names = _segment_names(2 * text + smaller, lms[after] - np.arange(n, dtype=np.int32) + np.int32(1))
    distinct, reduced = np.unique(names[lms], return_inverse=True)
    if len(distinct) == len(lms):
        lms_rank = reduced.astype(np.int32)
    else:
        # The last LMS position is the end mark, whose name is the smallest and stands once.
        lms_rank = np.empty(len(lms), np.int32)
        lms_rank[_sorted_suffixes(reduced.astype(np.int32))] = np.arange(len(lms), dtype=np.int32)
    key = names.astype(np.int64)
    del names
    key *= len(lms) + 1
    key += lms_rank[after]
    return np.argsort(key)


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position its predecessor in the suffix array and the length of their common prefix.

    Only irreducible values (those whose preceding bytes differ) are compared, eight bytes at a time; each
    other value is one less than its left neighbour's.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    if n == 0:
        return before, before
    plcp = np.zeros(n, np.int32)
    at = np.arange(n, dtype=np.int32)
    left, left_of_before = data[np.maximum(at - np.int32(1), 0)], data[np.maximum(before - np.int32(1), 0)]
    whole = (at == 0) | (before <= 0) | (left != left_of_before)
    padded = np.concatenate([data, np.arange(16, dtype=np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    todo = np.flatnonzero(whole & (before >= 0)).astype(np.int32)
    length = 0
    while len(todo):
        a, b = todo + np.int32(length), before[todo] + np.int32(length)
        differ = eight[np.minimum(a, n)] ^ eight[np.minimum(b, n)]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(low.astype(np.float64), where=low > 0, out=np.zeros(len(low))).astype(np.int64) >> 3)
        equal = np.minimum(equal, n - np.maximum(a, b))
        plcp[todo] += equal
        todo = todo[equal == 8]
        length += 8
    source = np.maximum.accumulate(np.where(whole, at, np.int32(0)))
    plcp = np.maximum(plcp[source] - (at - source), 0)
    return before, plcp


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """For each entry of a suffix array of integers its common prefix with the entry before (0 for the first).

    As in ``permuted_prefixes`` only irreducible values are compared, in stretches that double with what is already equal.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    at = np.arange(n)
    starts = text[np.maximum(before, 0)] == text
    left = np.concatenate([[True], text[np.maximum(before[1:] - 1, 0)] != text[:-1]])
    whole = left | (before <= 0) | ~starts
    padded = np.append(text, -1)
    todo = np.flatnonzero(whole & starts & (before >= 0))
    width = 2
    while len(todo):
        rest = []
        for first in range(0, len(todo), max(1, most // width)):
            own = todo[first : first + max(1, most // width)]
            ahead = shared[own][:, None] + np.arange(width)
            differ = padded[np.minimum(own[:, None] + ahead, n)] != padded[np.minimum(before[own][:, None] + ahead, n)]
            some = differ.any(1)
            shared[own] += np.where(some, differ.argmax(1), width)
            rest.append(own[~some])
        todo = np.concatenate(rest)
        width = min(2 * width, most)
    source = np.maximum.accumulate(np.where(whole, at, 0))
    shared = np.maximum(shared[source] - (at - source), 0)
    return shared[order]
