"""String similarities that Spark lacks, as Arrow-batched functions over distinct values."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, in percent."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    # Bit-parallel longest common subsequence: one bit for each character of a.
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best of the similarities of common words, and of these with each side's other words."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_left, only_right = sorted(left & right), sorted(left - right), sorted(right - left)
    if both and (not only_left or not only_right):
        return 100.0
    common = " ".join(both)
    x, y = (" ".join([*both, *rest]) for rest in (only_left, only_right))
    found = [indel_ratio(x, y)]
    if common:
        found += [indel_ratio(common, x), indel_ratio(common, y)]
    return max(found)


class TermTable:
    """Terms that a batch of texts is compared with at once, by the same similarity as ``token_set_ratio``.

    The pair's common words are a prefix of both sides, so only the subsequence of the other words is open. It is
    found bit-parallel: one machine word (or a longer number) for each text of the batch, one step for each character. Texts are left out of a term's steps when
    their length, or the characters that they have in common with it, cannot beat what they have found.
    """

    def __init__(self, terms: list[str]):
        self.words = [sorted(set(t.split())) for t in terms]
        self.counts = [np.bincount(_codes([" ".join(w)])[0], minlength=CODES)[:CODES] for w in self.words]

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its first best term (-1 without any), and the score."""
        own = [sorted(set(t.split())) for t in texts]
        with_word: dict[str, list[int]] = {}
        for k, words in enumerate(own):
            for w in words:
                with_word.setdefault(w, []).append(k)
        matrix = _codes([" ".join(w) for w in own])
        sizes = (matrix > 0).sum(1)
        counts = np.stack([(matrix == c).sum(1) for c in range(CODES)], 1) if len(texts) else np.zeros((0, CODES), np.int64)
        which, score = np.full(len(texts), -1), np.full(len(texts), -1.0)
        for number, words in enumerate(self.words):
            if not words:
                continue
            whole = " ".join(words)
            sharing = sorted({k for w in words for k in with_word.get(w, ())})
            for k in sharing:  # texts with a word of the term: few, each with its own other words
                found = _shared_score(own[k], words)
                if found > score[k]:
                    which[k], score[k] = number, found
            common = np.minimum(counts[:, 1:], self.counts[number][1:]).sum(1)
            bound = np.where(sizes > 0, 200.0 * np.minimum(common, np.minimum(sizes, len(whole))) / np.maximum(sizes + len(whole), 1), 0.0)
            bound[sharing] = -1.0
            open_ = np.flatnonzero(bound > score)
            found = np.where(sizes[open_] > 0, 200.0 * _subsequences(matrix[open_], whole) / (sizes[open_] + len(whole)), 0.0)
            better = found > score[open_]
            which[open_[better]], score[open_[better]] = number, found[better]
        return which, score


#: Codes of characters: 0 pads, others have their own up to this number, and the rest the last one, which no term has.
CODES = 128


def _codes(texts: list[str]) -> np.ndarray:
    """Characters of the texts, one row each, padded with 0."""
    wide = max(map(len, texts), default=0)
    if not wide:
        return np.zeros((len(texts), 0), np.uint8)
    rows = np.array(texts, dtype=f"<U{wide}").view(np.uint32).reshape(len(texts), wide)
    return np.where(rows < CODES - 1, rows, CODES - 1).astype(np.uint8) * (np.arange(wide) < np.array([len(t) for t in texts])[:, None])


def _subsequences(matrix: np.ndarray, term: str) -> np.ndarray:
    """Length of the longest common subsequence of the term and each row."""
    short = len(term) < 64
    kind = np.uint64 if short else object
    masks = np.zeros(CODES, kind) if short else np.array([0] * CODES, object)
    for k, c in enumerate(term):
        if 0 < ord(c) < CODES - 1:
            masks[ord(c)] |= kind(1 << k) if short else 1 << k
    full = kind((1 << len(term)) - 1) if short else (1 << len(term)) - 1
    row = np.full(len(matrix), full, kind)
    for column in matrix.T:
        hit = row & masks[column]
        row = (row + hit | row - hit) & full
    left = np.bitwise_count(row) if short else np.array([x.bit_count() for x in row], np.int64)
    return len(term) - left.astype(np.int64)


def _shared_score(own: list[str], words: list[str]) -> float:
    """The similarity of a text and a term (sorted words) that have words in common."""
    both = " ".join(w for w in words if w in own)
    x, y = (" ".join(w for w in a if w not in b) for a, b in ((own, words), (words, own)))
    if not x or not y:
        return 100.0
    size, a, b = len(both), len(both) + 1 + len(x), len(both) + 1 + len(y)
    same = size + 1 + int(_subsequences(_codes([x]), y)[0])
    return max(200.0 * same / (a + b), 200.0 * size / (size + a), 200.0 * size / (size + b))


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _pairwise(score):
    def rows(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else score(a, b) for a, b in zip(left, right)], dtype="float64")

    return rows


def token_set_ratio_udf():
    return F.pandas_udf(_pairwise(token_set_ratio), "double")


def sequence_ratio_udf():
    return F.pandas_udf(_pairwise(sequence_ratio), "double")
