"""Vectorised scans over the concatenated bytes of many texts: words, word hashes, rolling hashes."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(8)
def byte_values(seed: int = 7) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), seed)


PRIME = (1 << 61) - 1
_P, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x >> _61) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers under it: the high halves have 30 bits, the low ones 31."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = ah * bl + al * bh
    return _reduced(np.uint64(2) * ah * bh + (middle >> _30) + ((middle & _LOW30) << _31) + al * bl)


@functools.lru_cache(8)
def base_of(seed: int) -> int:
    return int(mix(np.array([seed], np.uint64), 40)[0]) % (PRIME - 1000) + 500


#: Bytes that are summed at once, a power of two; 9 bits of a byte, 31 of half a power and this many never overflow.
STEP = 1 << 15


@functools.lru_cache(4)
def powers(base: int) -> np.ndarray:
    """base ** k modulo PRIME for k under STEP."""
    out, width = np.ones(STEP, np.uint64), 1
    while width < STEP:
        out[width : 2 * width] = times(out[:width], np.uint64(pow(base, width, PRIME)))
        width *= 2
    return out


class SpanHash:
    """Hashes of any spans of a buffer, from prefix sums; equal bytes have equal hashes.

    A span is a polynomial of its bytes modulo the prime 2^61 - 1, taken at a base drawn by ``seed``: two spans of n bytes
    agree for n of the 2^61 bases at most, and hashes of two seeds are taken at two bases. Sums begin anew with each STEP
    bytes, so that the tables of powers, which stay in the process, are as small for a buffer of any length.
    """

    def __init__(self, data: np.ndarray, seed: int = 7):
        n, base = len(data), base_of(seed)
        back = pow(base, -1, PRIME)
        self.inverse = powers(back)
        high, low = powers(base) >> _31, powers(base) & _LOW31
        self.sums = np.zeros(n + 1, np.uint64)  # of the bytes before each place, from the last multiple of STEP on
        steps = n // STEP + 1
        self.before, self.up, self.down = (np.zeros(steps, np.uint64) for _ in range(3))  # of each step: the sum of all bytes before it, and its power
        before, up, down, ahead, astern = 0, 1, 1, pow(base, STEP, PRIME), pow(back, STEP, PRIME)
        for k in range(steps):
            self.before[k], self.up[k], self.down[k] = before, up, down
            value = data[k * STEP : (k + 1) * STEP].astype(np.uint64) + np.uint64(1)
            upper, lower = np.cumsum(value * high[: len(value)]), np.cumsum(value * low[: len(value)])
            lower += upper >> _30
            lower += (upper & _LOW30) << _31
            lower = _reduced(lower)
            self.sums[k * STEP + 1 : (k + 1) * STEP] = lower[: STEP - 1]
            if len(value) == STEP:  # the place after it begins the next step, at 0
                before = (before + up * int(lower[-1])) % PRIME
                up, down = up * ahead % PRIME, down * astern % PRIME

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = _reduced(self.sums[ends] + _P - self.sums[starts])
        across = np.flatnonzero((starts ^ ends) >= STEP)
        if len(across):
            x, y = starts[across] // STEP, ends[across] // STEP
            whole = _reduced(self.before[y] + _P - self.before[x] + times(self.up[y], self.sums[ends[across]]))
            whole = _reduced(whole + _P - times(self.up[x], self.sums[starts[across]]))
            value[across] = times(whole, self.down[x])
        raw = times(value, self.inverse[starts & (STEP - 1)])
        return mix(raw ^ mix((ends - starts).astype(np.uint64), 3))


class Words:
    """Words of texts in a buffer: ``start``, ``end``, ``doc`` and ``first`` (words before each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, by_place: bool = False):
        """is_word: 256 booleans, which bytes belong to words; or ``by_place`` one for each place. A word never crosses texts."""
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = is_word if by_place else is_word[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()


@functools.lru_cache(1)
def letter_kinds() -> np.ndarray:
    """For each code point 1 for a letter, 2 for a mark on one, 0 for all else."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def letters(data: np.ndarray) -> np.ndarray:
    """The kind, as ``letter_kinds`` has it, of the character that each byte of UTF-8 belongs to."""
    out = letter_kinds()[:128][np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0xFF >> (size + 1))
    for k in range(1, 4):
        on = size > k
        code[on] = code[on] << 6 | data[lead[on] + k] & 0x3F
    kind = letter_kinds()[code]
    out[lead] = kind
    for k in range(1, 4):
        on = size > k
        out[lead[on] + k] = kind[on]
    return out
#: Words by white space: all bytes but space and the controls 9 to 13.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Words of digits, letters and all beyond ASCII (texts in lower case already).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Which words start a window of ``size`` words inside their own text; ``first``: words before each text."""
    out = np.zeros(int(first[-1]), bool)
    for a, b in zip(first[:-1], first[1:]):
        out[a : max(a, b - size + 1)] = True
    return out


def gram_hashes(hashes: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """The hash of each run of ``size`` consecutive word hashes, as far as there are so many: each place has its own factor."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(size, dtype=np.uint64), seed + 90) | np.uint64(1)
    out = hashes[:n] * factors[0]
    for k in range(1, size):
        out += hashes[k : k + n] * factors[k]
    return mix(out, seed)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum over x[i : i + size] for each i with a full window, in linear time."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % size
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, size)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` bytes, a power of two, by doubling. They choose places; nothing is told apart by them."""
    h, width, base = byte_values()[data], 1, 0x9E3779B97F4A7C15
    while width < size:
        h = h[: max(len(h) - width, 0)] * np.uint64(base) + h[width:]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        width *= 2
    return mix(h, 5)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and text of each line, and the lines before each text; every text has a line at least."""
    docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    doc = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(docs)])
    ends = np.concatenate([breaks, offsets[1:]])
    # A text's last line ends at its own end, after its breaks.
    order = np.lexsort((np.concatenate([np.zeros(len(breaks), np.int8), np.ones(docs, np.int8)]), ends, doc))
    ends, doc = ends[order], doc[order]
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    starts = np.where(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)], offsets[doc], starts)
    return starts, ends, doc, np.searchsorted(doc, np.arange(docs + 1))
