"""Every registered corpus query: against its SQL where it has some, else against plain Python, over the smallest tables."""

import collections
import os
import zlib

import duckdb
import pytest

import __spark_entry__
from ledgerloom import llm
from ledgerloom.llm import bpe, secret_scan

from .test_operators import base_spans, brute_hits, brute_measures, brute_repeats, sha

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = llm.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    plain = lambda v: "%.12g" % v if isinstance(v, float) else str(v)
    own = sorted([plain(r[c]) for c in columns] for r in df.collect())
    result = duck.execute(llm.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert own == sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())


def rows(spark, name):
    return {r.doc_id: r for r in __spark_entry__.queries()[name](spark, DATA).collect()}


def test_op1(spark, texts):
    got = rows(spark, "op1_suffix_array_dedup")
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.values()), key=str) == brute_repeats(list(texts.items()))


def test_op1_passages(spark, texts):
    """The query tells all bytes of repeated passages that are shorter than what it removes."""
    got = {i: r.n_repeated for i, r in rows(spark, "op1_suffix_array_dedup").items()}
    assert got == {i: n for i, _, n, *_ in brute_repeats(list(texts.items()), 280)}


def test_op2(spark, duck, texts):
    items = duck.execute("select item_id, text from benchmark").fetchall()
    got = rows(spark, "op2_benchmark_decontamination")
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.values()), key=str) == brute_hits(list(texts.items()), items)


def test_op4(spark, texts):
    for i, r in rows(spark, "op4_quality_rules").items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(texts[i])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and (r.cutoff is None or r.score < r.cutoff))


def test_op5(spark, duck, texts):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    got = rows(spark, "op5_language_spans")
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i] or ""))
    held = [i for i, r in got.items() if r.held_out and lang[i] is not None and r.lang_pred != "und"]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.9 * len(held)


def test_op9(spark, texts):
    for i, r in rows(spark, "op9_secret_randomness").items():
        base = base_spans(texts[i])
        kinds = collections.Counter(k for _, _, _, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds[k] for k in secret_scan.KINDS)
        written = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == sha(written.encode())
        spans = [s for s in r.spans.split(",") if s]
        assert ",".join(s for s in spans if not s.startswith("random:")) == written
        for s in spans:
            kind, a, b = s.split(":")
            assert 0 <= int(a) < int(b) <= len(texts[i] or "")


def test_op10(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    for i, r in rows(spark, "op10_bpe_prefix_dp").items():
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(packed))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())
