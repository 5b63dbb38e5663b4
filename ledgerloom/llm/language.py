"""Op 5: language ID of spans, by scripts, word scores and Viterbi.

A word is a run of letters and of marks on letters (of any script, by code point). Each language has the frequencies of byte trigrams of its words (with word borders), counted
over all labelled documents of the training folds, and the shares of scripts among its words. A word's script, told by
the ranges of its bytes, narrows the languages to those that use it; over these the word's score is the sum of its
trigrams' log-probabilities. The best sequence of languages, with a penalty for each switch, labels the words;
runs of one label are spans. The document's language is that of most bytes of words, the score their share.

The Viterbi pass runs over blocks of texts at once: the words of a block are one sequence in which a text's first
word switches freely, cut in pieces that are advanced side by side from every possible state, then chained.

Defined cases: a null text, or one without letters, is ``und`` with score 0; so is any text if nothing could be
learned (marks alone are no letters); ties go to the language first in alphabetical order; repeated rows are labelled alike (and counted
twice in training, where they are rows); a null language is not learned from; an empty table gives no rows; long
texts are read whole; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .runtime import BLOCK_BYTES, blocks, bytes_of, keep, table

FOLDS, HELD_OUT = 4, 2
#: Most languages of a model, which bounds its table (GRAMS numbers of 4 bytes for each): with more, learning stops with an error.
MOST_LANGUAGES = 512
#: Languages that a learning task counts for at once; numbers of a table that a labelling step works on.
COUNTED, ROOM = 32, 1 << 21
GRAMS = 1 << 16
SMOOTHING = 0.1
#: Log-probability that a switch costs.
SWITCH = 10.0
#: Least share of a script among a language's words for the language to be a candidate there.
SCRIPT_SHARE = 0.01
#: Words that are advanced side by side.
PIECE = 256
NEVER = -1e9

def _scripts() -> np.ndarray:
    """Script of each lead byte: 0 Latin (and all that tells nothing), then Greek to Hangul."""
    out = np.zeros(256, np.uint8)
    for script, (low, high) in enumerate([(0xCD, 0xCF), (0xD0, 0xD3), (0xD4, 0xD6), (0xD7, 0xD7), (0xD8, 0xDB), (0xE0, 0xE1), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED)], 1):
        out[low : high + 1] = script
    return out


SCRIPT = _scripts()
SCRIPTS = 16


def word_grams(data: np.ndarray, words: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all words, end to end, and where each word's start. A word of n bytes has n + 1."""
    low = B.LOWER[data].astype(np.uint32)
    size = words.end - words.start
    first = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], size + 1)  # place in the word; its size at the closing border
    source = at + np.repeat(words.start, size + 1)
    closing = first[1:] - 1
    now = low[np.minimum(source, max(len(low) - 1, 0))] if len(low) else low
    now[closing] = 0
    one = np.where(at >= 1, low[np.maximum(source - 1, 0)], 0) if len(low) else low
    two = np.where(at >= 2, low[np.maximum(source - 2, 0)], 0) if len(low) else low
    return ((two << 16 | one << 8 | now) * np.uint32(2654435761)) >> np.uint32(16), first[:-1]


def word_scripts(data: np.ndarray, words: B.Words) -> np.ndarray:
    top = SCRIPT[data]
    bounds = np.stack([words.start, words.end], axis=1).ravel()
    if not len(bounds):
        return np.zeros(0, np.uint8)
    return np.maximum.reduceat(np.append(top, np.uint8(0)), bounds)[::2]


def _counts(batches):
    """Rows (lang, key, count) of a task's trigrams (key from 0) and scripts (key from GRAMS)."""
    names: dict[str, int] = {}
    total = np.zeros((0, GRAMS + SCRIPTS), np.int64)

    def told():
        which, key = np.nonzero(total)
        langs = list(names)
        return pa.RecordBatch.from_arrays([pa.array([langs[k] for k in which], pa.string()), pa.array(key.astype(np.int32)), pa.array(total[which, key])], ["lang", "key", "count"])

    for batch in batches:
        for part in blocks(batch, "text"):
            if len(names) > COUNTED:  # what was counted goes out, so that a task holds few languages
                yield told()
                names, total = {}, np.zeros((0, GRAMS + SCRIPTS), np.int64)
            own = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()])
            total = np.concatenate([total, np.zeros((len(names) - len(total), GRAMS + SCRIPTS), np.int64)])
            data, offsets = bytes_of(part.column("text"))
            words = B.Words(data, offsets, B.letters(data) > 0, by_place=True)
            grams, first = word_grams(data, words)
            lang = own[words.doc]
            size = words.end - words.start + 1
            flat = total.ravel()
            flat += np.bincount(np.repeat(lang, size) * (GRAMS + SCRIPTS) + grams, minlength=len(flat))
            flat += np.bincount(lang * (GRAMS + SCRIPTS) + GRAMS + word_scripts(data, words), minlength=len(flat))
            total = flat.reshape(total.shape)
    yield told()


class Model:
    def __init__(self, rows: pa.Table):
        """rows: lang, key and count, one row for each lang and key."""
        self.langs = sorted(rows["lang"].unique().to_pylist())
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages; a model has {MOST_LANGUAGES} at most")
        number = rows["lang"].combine_chunks().dictionary_encode()
        counts = np.zeros((len(self.langs), GRAMS + SCRIPTS))
        place = np.array([self.langs.index(x) for x in number.dictionary.to_pylist()], np.int64)
        counts[place[np.asarray(number.indices)], rows["key"].to_numpy()] = rows["count"].to_numpy()
        grams, scripts = counts[:, :GRAMS] + SMOOTHING, counts[:, GRAMS:]
        self.table = np.ascontiguousarray(np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)) if self.langs else np.zeros((GRAMS, 0), np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        allowed = share.T >= SCRIPT_SHARE
        self.allowed = allowed | ~allowed.any(axis=1, keepdims=True)  # a script of no language tells nothing

    def word_scores(self, data: np.ndarray, words: B.Words) -> np.ndarray:
        """words x languages."""
        grams, first = word_grams(data, words)
        states = len(self.langs)
        scores = np.empty((len(words), states))
        bounds = np.append(first, len(grams))
        at = 0
        while at < len(words):  # some words at once, one at least
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + ROOM // max(1, states), "right")) - 1)
            scores[at:stop] = np.add.reduceat(self.table[grams[bounds[at] : bounds[stop]]], first[at:stop] - first[at], axis=0)
            at = stop
        return np.where(self.allowed[word_scripts(data, words)], scores, NEVER)


def _advance(v: np.ndarray, score: np.ndarray, penalty: np.ndarray):
    best = v.max(axis=-1, keepdims=True) - penalty
    return np.maximum(v, best) + score, best


def best_path(scores: np.ndarray, resets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; at ``resets`` (first words of texts) a switch is free."""
    n, states = scores.shape
    if n == 0 or states == 0:
        return np.zeros(n, np.int64)
    scores = scores - scores.max(axis=1, keepdims=True)
    pieces = -(-n // PIECE)
    pad = pieces * PIECE - n
    e = np.concatenate([scores, np.zeros((pad, states))]).reshape(pieces, PIECE, states)
    free = np.concatenate([np.where(resets, 0.0, switch), np.full(pad, switch)]).reshape(pieces, PIECE)
    # From every state at a piece's start to every state at its end, for some pieces at once.
    begin = np.zeros((pieces + 1, states))
    some = max(1, ROOM // states**2)
    for low in range(0, pieces, some):
        own = slice(low, min(low + some, pieces))
        v = np.broadcast_to(np.where(np.eye(states, dtype=bool), 0.0, NEVER * 4), (own.stop - low, states, states)).copy()
        for t in range(PIECE):
            v, _ = _advance(v, e[own, t, None, :], free[own, t, None, None])
        for k in range(low, own.stop):
            begin[k + 1] = (begin[k][:, None] + v[k - low]).max(axis=0)
            begin[k + 1] -= begin[k + 1].max()
    begin = begin[:pieces]
    # Again from the true values, noting where each state came from.
    back = np.empty((PIECE, pieces, states), np.min_scalar_type(states))
    v = begin
    here = np.arange(states)
    for t in range(PIECE):
        nxt, best = _advance(v, e[:, t], free[:, t, None])
        back[t] = np.where(v >= best, here, v.argmax(axis=1)[:, None])
        v = nxt
    rows = np.arange(pieces)[:, None]
    came = np.broadcast_to(here, (pieces, states))
    for t in range(PIECE - 1, -1, -1):
        came = back[t][rows, came]
    last = np.empty(pieces, np.int64)
    last[-1] = v[-1].argmax()
    for k in range(pieces - 1, 0, -1):
        last[k - 1] = came[k, last[k]]
    out = np.empty((pieces, PIECE), np.int64)
    for t in range(PIECE - 1, -1, -1):
        out[:, t] = last
        last = back[t][rows[:, 0], last]
    return out.ravel()[:n]


OUT = "doc_id long, lang_pred string, score double, spans array<struct<start:long,stop:long,lang:string>>"


def _labelled(shared):
    def labelled(batches):
        model = shared.value
        states = len(model.langs)
        for batch in batches:
            for part in blocks(batch, "text", 16 * BLOCK_BYTES // max(16, states)):
                data, offsets = bytes_of(part.column("text"))
                kinds = B.letters(data)
                words = B.Words(data, offsets, kinds > 0, by_place=True)
                docs = part.num_rows
                resets = np.zeros(len(words), bool)
                resets[words.first[:-1][np.diff(words.first) > 0]] = True
                label = best_path(model.word_scores(data, words), resets)
                size = (words.end - words.start).astype(np.float64)
                mass = np.bincount(words.doc * max(states, 1) + label, size, docs * max(states, 1)).reshape(docs, -1)
                total = np.concatenate([[0], np.cumsum(kinds == 1)])
                known = (total[offsets[1:]] > total[offsets[:-1]]) & (states > 0)
                top = mass.argmax(axis=1)
                share = np.where(known, mass.max(axis=1) / np.maximum(1, mass.sum(axis=1)), 0.0)
                new = resets | np.concatenate([[True], label[1:] != label[:-1]])[: len(label)]
                at = np.flatnonzero(new)
                stop = np.append(at[1:], len(words))[: len(at)] - 1
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                doc = words.doc[at]
                starts, stops = points[words.start[at]] - points[offsets[doc]], points[words.end[stop]] - points[offsets[doc]]
                on = known[doc]
                names = np.array(model.langs or ["und"], object)
                spans = pa.StructArray.from_arrays([pa.array(starts[on], pa.int64()), pa.array(stops[on], pa.int64()), pa.array(names[label[at][on]], pa.string())], ["start", "stop", "lang"])
                cuts = np.searchsorted(doc[on], np.arange(docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.where(known, names[top if states else np.zeros(docs, int)], "und"), pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(cuts), spans)], ["doc_id", "lang_pred", "score", "spans"]
                )

    return labelled


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """The model of all labelled rows (text, lang); only its table, bounded by MOST_LANGUAGES, reaches the driver."""
    counts = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_counts, "lang string, key int, count long")
    counts = keep(counts.groupBy("lang", "key").agg(F.sum("count").alias("count")), "language-counts")
    if (found := counts.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{found} languages; a model has {MOST_LANGUAGES} at most")
    return Model(counts.toArrow())


def label_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans (code points) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_labelled(shared), OUT)


def op5_language_spans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = label_languages(docs, learn(docs.filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
