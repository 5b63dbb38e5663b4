"""The corpus pipeline against plain Python: each of its five stages, and run() as a whole."""

import collections
import hashlib
import math
import os
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom import llm
from ledgerloom.llm import bpe, decontaminate, quality

from .test_operators import brute_components, brute_hits, brute_measures, words_of

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


# Documents are (doc_id, text, lang), in order.


def plain_quality(docs, labels, sf_dir=None):
    good = {}
    for i, q in labels:
        if q is not None:
            good[i] = min(q, good.get(i, q))
    scored = []
    for i, text, lang in docs:
        t, w = text or "", words_of(text)
        n, _, symbols, dup, repeats = brute_measures(text)
        letters = sum(c.isascii() and c.isalpha() for c in t)
        capitals = sum("A" <= c <= "Z" for c in t)
        lines = sum(bool(words_of(x)) for x in t.split("\n"))
        echoes = sum(a == b for a, b in zip(w, w[1:]))
        shares = {"symbols": (symbols, n), "exclaims": (t.count("!"), n), "capitals": (capitals, letters), "lines": (dup, lines), "echoes": (echoes, n)}
        score = max((a / b if b else 0.0) / quality.SCALES[k] for k, (a, b) in shares.items())
        scored.append((i, lang or "", score, n < 10 or 100 * repeats > 20 * n))
    held = collections.defaultdict(list)
    for i, stratum, score, failed in scored:
        if not failed and good.get(i) == 1:
            held[stratum].append(score)
    cutoffs = {}
    for stratum, scores in held.items():
        n, alpha = len(scores), Fraction(str(quality.ALPHA))
        for cutoff in quality.CUTOFFS:
            x = sum(s >= cutoff for s in scores)
            tail = sum(math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k) for k in range(x + 1))
            if x >= quality.ALPHA * n or tail > quality.DELTA / len(held):
                break
            cutoffs[stratum] = cutoff
    return [d for d, (_, stratum, score, failed) in zip(docs, scored) if not failed and not score >= cutoffs.get(stratum, math.inf)]


def plain_lines(docs):
    seen, out = set(), []
    for i, text, lang in sorted(set(docs), key=lambda d: d[0]):
        if text is not None:
            lines = text.split("\n")
            gone = set()
            for k in range(len(lines) - 2):
                window = tuple(lines[k : k + 3])
                if any(map(words_of, window)):
                    if window in seen:
                        gone |= {k, k + 1, k + 2}
                    seen.add(window)
            if gone and len(gone) == len(lines):
                continue
            text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, text, lang))
    return out


def plain_near(docs):
    own = {c for _, _, c in brute_components([(i, t) for i, t, _ in docs])}
    return [d for d in docs if d[0] in own]


def plain_clean(docs, benchmark):
    dirty = {r[0] for r in brute_hits([(i, t) for i, t, _ in docs], benchmark) if r[5]}
    return [d for d in docs if d[0] not in dirty]


def plain_ids(docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    out = {}
    for i, text, _ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        back = library.decode(ids, skip_special_tokens=False).encode()
        out[i] = (text, packed, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
    return out


def test_run(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = [(r.doc_id, r.text, r.lang) for r in documents.orderBy("doc_id").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = [lambda d: plain_quality(d, labels), plain_lines, plain_near, lambda d: plain_clean(d, benchmark)]
    now = documents
    for (name, stage), brute in zip(P.STAGES, plain):
        docs = brute(docs)
        now = P.keep(stage(spark, now, DATA), name)
        assert now.columns == documents.columns
        assert sorted((r.doc_id, r.text, r.lang) for r in now.collect()) == sorted(docs), name
    assert all(r.n_chars == len(r.text) for r in now.collect())
    want = plain_ids(docs)
    got = P.run(spark, DATA).collect()
    assert {r.doc_id: (r.text, bytes(r.token_ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, ties and extra columns of the operators' names; and no rows at all."""
    text = " ".join(f"w{k}" for k in range(60))
    lines = "\n".join(" ".join(f"l{k}x{j}" for j in range(6)) for k in range(6))
    rows = [(1, text, "en"), (1, text, "en"), (2, None, None), (3, "", "en"), (4, lines, "en"), (5, lines, None), (6, text + " more", "de"), (None, text[:90], "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"__q_kept": F.lit(1), "__ll_rid": F.lit("x"), "__hit_words": F.lit(2), "leader": F.lit(3)})
    kept = []
    for name, stage in P.STAGES:
        before, docs = docs, P.keep(stage(spark, docs, DATA), name)
        assert docs.columns[: len(before.columns)] == before.columns, name
        kept.append(sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.collect()))
    # The null and the empty text fail the base; text 5 loses all its lines to 4; copies of 1 are one, and 6 is near them.
    assert kept[0] == [-1, 1, 1, 4, 5, 6] and kept[1] == [-1, 1, 1, 4, 6]
    assert kept[2] == [-1, 1, 4] and kept[3] == kept[4] == kept[2]
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        none = P.keep(stage(spark, none, DATA), name)
        assert none.count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in llm.MODULES if n not in names] == []
    assert decontaminate.WINDOW == 10
