"""Op 4: quality rules whose cutoffs are risk-controlled on labelled holdouts.

Base rules reject texts of few words and texts that mostly repeat themselves. On top, each document has a score:
the largest of its symbol, shouting, exclamation, repeated-line and echoed-word shares, each as a multiple of a fixed scale.
In every stratum (language) the labelled good documents are the holdout. Cutoffs are tried from the laxest to
the strictest, each by an exact binomial test of "more than ``ALPHA`` of the good documents are rejected" (the
same as asking that the upper Clopper-Pearson bound be ``ALPHA`` at most), and the first that fails ends
the sequence; the level is ``DELTA`` divided by the number of strata. So with probability 1 - DELTA the cutoff of no stratum
rejects more than ALPHA of the good documents that pass the base rules; what the base rules reject is fixed beforehand and
outside this guarantee. A stratum with too few labels is not certified: it has no cutoff and rejects nothing beyond the base.
``certified_strata`` tells them apart.

Defined cases: a null text has no words and fails the base; null and empty languages are one stratum; labels
that are null or for other documents count nowhere, the lowest of repeated labels counts; repeated rows are judged
alike; an empty table gives no rows; long texts are measured whole; extra columns, of any name, pass through
``accepted``; ``measured`` replaces those of its own names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as B
from .runtime import append_columns, keep, shielded, table

ALPHA = 0.02
DELTA = 0.05
#: Multiples of the scales that are tried as cutoffs, laxest first.
CUTOFFS = [8.0, 6.0, 4.0, 3.0, 2.0, 1.5, 1.25, 1.0]
#: What counts as 1: symbols and exclamation marks a word, shares of capitals in letters, of repeated lines, and of
#: words that equal the one before.
SCALES = {"symbols": 0.3, "exclaims": 0.3, "capitals": 0.5, "lines": 0.6, "echoes": 0.3}
LEAST_WORDS = 10
MOST_REPEATED = 20

MEASURES = [T.StructField(f"__q_{n}", T.LongType()) for n in ("words", "chars", "symbols", "dup_lines", "repeats", "lines", "exclaims", "capitals", "letters", "echoes")]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


SYMBOLS, EXCLAIM = _table(b"#*$%&|<>"), _table(b"!")
CAPITALS = _table(bytes(range(65, 91)))
LETTERS = CAPITALS + _table(bytes(range(97, 123)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(hashes: np.ndarray, words: B.Words, size: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words which the text has twice or more."""
    docs = len(words.first) - 1
    grams = B.gram_hashes(hashes, size)
    if not len(grams):
        return np.zeros(docs, np.int64)
    at = np.flatnonzero(B.window_starts(words.first, size)[: len(grams)])
    own = B.mix(grams[at] ^ B.mix(words.doc[at].astype(np.uint64), 17), 19)
    order = np.argsort(own)
    ordered = own[order]
    same = np.concatenate([[False], ordered[1:] == ordered[:-1], [False]])
    twice = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + size, -1)
    return _sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), words.first)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, filled: np.ndarray, hashed: B.SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line, of each text."""
    docs = len(offsets) - 1
    starts, ends, doc, _ = B.line_spans(data, offsets)
    total = np.concatenate([[0], np.cumsum(filled)])
    has = total[ends] > total[starts]
    starts, ends, doc = starts[has], ends[has], doc[has]
    lines = np.bincount(doc, minlength=docs)
    own = B.mix(hashed(starts, ends) ^ B.mix(doc.astype(np.uint64), 23), 29)
    _, index = np.unique(own, return_index=True)
    return lines, lines - np.bincount(doc[index], minlength=docs)


def measure(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    filled = B.SPACED[data]
    words = B.Words(data, offsets, B.SPACED)
    hashed = B.SpanHash(data)
    chars = _sums(filled & ((data & 0xC0) != 0x80), offsets)
    lines, dup_lines = repeated_lines(data, offsets, filled, hashed)
    names = hashed(words.start, words.end)
    echo = np.zeros(len(words), np.int64)
    echo[1:] = (names[1:] == names[:-1]) & (words.doc[1:] == words.doc[:-1])
    out = [np.diff(words.first), chars, _sums(SYMBOLS[data], offsets), dup_lines, repeated_words(names, words), lines, *(_sums(t[data], offsets) for t in (EXCLAIM, CAPITALS, LETTERS)), _sums(echo, words.first)]
    return [pa.array(np.asarray(x, np.int64)) for x in out]


def measured(docs: DataFrame) -> DataFrame:
    """The columns of docs and those of MEASURES."""
    return append_columns(docs.drop(*(f.name for f in MEASURES)), MEASURES, measure)


def _share(a: str, b: str, scale: str):
    return F.coalesce(F.try_divide(F.col(f"__q_{a}"), F.col(f"__q_{b}")), F.lit(0.0)) / SCALES[scale]


def score():
    return F.greatest(_share("symbols", "words", "symbols"), _share("exclaims", "words", "exclaims"), _share("capitals", "letters", "capitals"), _share("dup_lines", "lines", "lines"), _share("echoes", "words", "echoes"))


def base_failed():
    return (F.col("__q_words") < LEAST_WORDS) | (100 * F.col("__q_repeats") > MOST_REPEATED * F.col("__q_words"))


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(at most x of n) for independent chances p, exactly but for rounding."""
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certified(rejected: list[int], n: int, level: float, alpha: float = ALPHA) -> float | None:
    """The last cutoff of the sequence up to the first that is not shown to reject at most alpha."""
    best = None
    for cutoff, x in zip(CUTOFFS, rejected):
        # Beyond the mean the chance is over a half: no need of long sums.
        if n == 0 or x >= alpha * n or binomial_tail(x, n, alpha) > level:
            break
        best = cutoff
    return best


def _certify(level: float, alpha: float):
    def certify(frames):
        for frame in frames:
            found = [certified(list(map(int, r[2:])), int(r[1]), level, alpha) for r in frame.itertuples(index=False)]
            yield pd.DataFrame({"__q_stratum": frame["stratum"], "__q_cutoff": pd.Series(found, dtype="float64")})

    return certify


def stratum():
    return F.coalesce(F.col("lang"), F.lit(""))


def fit_cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A cutoff, or null, for each stratum of ``rows``: documents with their measures."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select(F.col("doc_id").alias("__q_id"))
    held = rows.filter(~base_failed()).select("doc_id", stratum().alias("stratum"), score().alias("score")).join(good, F.col("doc_id") == F.col("__q_id"))
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("score") >= c).alias(f"x{k}") for k, c in enumerate(CUTOFFS)])
    counts = keep(counts, "strata")
    level = delta / max(1, counts.count())
    return counts.mapInPandas(_certify(level, alpha), "__q_stratum string, __q_cutoff double")


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rows with __q_base_failed, __q_score, __q_cutoff and __q_kept."""
    out = rows.join(cutoffs, stratum() == F.col("__q_stratum"), "left").drop("__q_stratum")
    out = out.withColumns({"__q_base_failed": base_failed(), "__q_score": score()})
    return out.withColumn("__q_kept", ~F.col("__q_base_failed") & F.coalesce(F.col("__q_score") < F.col("__q_cutoff"), F.lit(True)))


def accepted(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    safe, names = shielded(docs, "doc_id", "lang", "text")
    rows = measured(safe)
    measures = keep(rows.select("doc_id", "lang", *(f.name for f in MEASURES)), "measures")
    cutoffs = keep(fit_cutoffs(measures, labels, alpha, delta), "cutoffs")
    return judged(rows, cutoffs).filter("__q_kept").select(names).toDF(*docs.columns)


def certified_strata(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoff (null: not certified, rejects nothing) and certified, for each stratum with labelled good documents."""
    out = fit_cutoffs(measured(docs.select("doc_id", "lang", "text")).drop("text"), labels, alpha, delta)
    return out.select(F.col("__q_stratum").alias("stratum"), F.col("__q_cutoff").alias("cutoff"), F.col("__q_cutoff").isNotNull().alias("certified"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = keep(measured(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"), "measures")
    out = judged(rows, fit_cutoffs(rows, table(spark, sf_dir, "labels")))
    long = {"n_words": "words", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "dup_lines", "n_repeat_words": "repeats"}
    return out.select("doc_id", *[F.col(f"__q_{c}").alias(n) for n, c in long.items()], F.col("__q_base_failed").alias("base_failed"), F.col("__q_kept").alias("kept"), F.col("__q_score").alias("score"), F.col("__q_cutoff").alias("cutoff"))


ORACLE_SQL = {
    "op4_quality_rules": rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT t.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS exclaims,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS echoes
  FROM t LEFT JOIN repeats ON t.doc_id = repeats.doc_id LEFT JOIN lines ON t.doc_id = lines.doc_id
), scored AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    greatest(coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) / {SCALES["symbols"]}::DOUBLE, coalesce(exclaims / nullif(n_words, 0)::DOUBLE, 0) / {SCALES["exclaims"]}::DOUBLE, coalesce(capitals / nullif(letters, 0)::DOUBLE, 0) / {SCALES["capitals"]}::DOUBLE,
      coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) / {SCALES["lines"]}::DOUBLE, coalesce(echoes / nullif(n_words, 0)::DOUBLE, 0) / {SCALES["echoes"]}::DOUBLE) AS score FROM m
), held AS (
  SELECT stratum, score FROM scored JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) good ON scored.doc_id = good.doc_id WHERE NOT base_failed
), tried AS (
  SELECT stratum, k, cutoff, count(*) AS n, count(*) FILTER (WHERE score >= cutoff) AS x, {DELTA} / (SELECT count(DISTINCT stratum) FROM held) AS level
  FROM held, (SELECT unnest({CUTOFFS}::DOUBLE[]) AS cutoff, unnest(range({len(CUTOFFS)})) AS k) GROUP BY stratum, k, cutoff
), judged AS (
  SELECT *, x < {ALPHA} * n AND list_sum(list_transform(range(x + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) <= level AS ok FROM tried
), cutoffs AS (
  SELECT stratum, arg_max(cutoff, k) FILTER (WHERE passed) AS cutoff FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY k) AS passed FROM judged) GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score < cutoff, true) AS kept, score, cutoff
FROM scored LEFT JOIN cutoffs ON scored.stratum = cutoffs.stratum
"""
}
