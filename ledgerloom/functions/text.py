"""Text normalisation as native column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import LEGAL_SUFFIXES, NOISE_TOKENS, STOPWORDS, TRANSFER_REFERENCE

#: Breaks of lines as Python's splitlines sees them.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def any_of(words: list[str]) -> str:
    """A pattern of literal words."""
    return "|".join("".join(f"\\{c}" if c in r"\.^$|?*+()[]{}-/" else c for c in w) for w in words)


def contains_any(text: Column, words: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@functools.lru_cache(1)
def _accents() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and these base characters: a rule, not a list."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    """Compatibility decomposition without marks, for characters with one base character."""
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{M}+", "")


def canonical(text: Column) -> Column:
    """Upper case for merchants: letters, digits and ``*./&-``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(without_accents(text)), r"[^A-Z0-9*./&\s-]", " "), r"\s+", " "))


def registry_name(text: Column) -> Column:
    """Upper case for company names: letters, digits and ``&.-``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(without_accents(text)), r"[^A-Z0-9\s&.-]", " "), r"\s+", " "))


def plain(text: Column) -> Column:
    """Lower case words of a transfer description without references and noise words."""
    low = F.lower(without_accents(F.coalesce(text, F.lit(""))))
    low = F.regexp_replace(low, TRANSFER_REFERENCE, " ")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s]", " "), r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin([t.lower() for t in NOISE_TOKENS])), " ")


def name_tokens(name: Column, screened: bool) -> Column:
    """Distinct tokens of a registry name, in order of appearance; ``screened`` leaves out suffixes and stopwords."""
    bare = F.transform(F.split(name, " "), lambda t: F.trim(t, F.lit(".-")))
    kept = F.filter(bare, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))
    if screened:
        kept = F.filter(kept, lambda t: ~t.isin(LEGAL_SUFFIXES) & ~F.lower(t).isin(STOPWORDS))
    return F.array_distinct(kept)


def prefixes(tokens: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: F.length(t) >= 4), lambda t: F.substring(t, 1, 4)))


def masked(line: Column) -> Column:
    """The key of a line: lower case, runs of digits as #."""
    return F.regexp_replace(F.lower(line), r"(?U)\d+", "#")


def lines_of(text: Column) -> Column:
    """Collapsed lines that are not blank."""
    return F.filter(F.transform(F.split(text, LINE_BREAK, -1), collapsed), lambda x: x != "")
