"""Patterns by their literal pieces, and similar terms of a whole batch, against loops over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.patterns import pieces
from ledgerloom.functions.similarity import TermTable, token_set_ratio
from ledgerloom.operators import merchants as M
from ledgerloom.operators import transfers as T


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"^MOLID\b", ["molid"]),
        ("CAFENEA|ZORI", ["cafenea", "zori"]),
        (r"(?:AB|CD)\s+NORDUL", ["nordul"]),
        (r"(LUX)+ORA?", ["lux"]),
        (r"(MOL)ID", ["molid"]),
        (r"MOL\bID", ["molid"]),
        (r"A{2,}BC", ["bc"]),
        (r"(?:AB|.*)", []),
        (r"[A-Z]{3}\d*", []),
        (r"X?(?:Y)*", []),
        (r"(?=PLATA)P.*A", ["p"]),
        (r"\p{L}+MOLID", []),
        ("", []),
    ],
)
def test_pieces(pattern, want):
    assert pieces(pattern) == want


def brute(texts, patterns):
    out = {}
    for text in texts:
        hits = [(k, n) for p, n, k in patterns if re.search(p, text, re.I)]
        if hits:
            out[text] = min(hits)[1]
    return out


def test_patterns_equal_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["MOLID", "ZORI", "NORD", "LUX", "A", "BC", "S1"])
    texts = sorted({" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"", "molid straße", "İZORİ"})
    make = [lambda: rf"\b{word()}\b", lambda: f"{word()}|{word()}", lambda: rf"{word()}\s+{word()}", lambda: f"^{word()}", lambda: f"({word()})+$", lambda: rf"[A-Z]\d", lambda: f"{word()}.{{0,3}}{word()}"]
    patterns = [(rng.choice(make)(), f"n{k}", (k * 37) % 101) for k in range(60)]
    texts = [t for t in texts if t.isascii()]
    got = M.pattern_alias(spark.createDataFrame([(t,) for t in texts], "norm string"), spark.createDataFrame(patterns, "pattern string, name string, priority int"))
    assert {r.norm: r.pattern_name for r in got.collect()} == brute(texts, patterns)


def test_twenty_thousand_patterns(spark):
    """Each text meets the few patterns whose piece it has: no pair of all, and no nested loop for them."""
    patterns = spark.range(20_000).select(F.concat(F.lit(r"\bSHOP"), F.col("id").cast("string"), F.lit(r"[XY]\b")).alias("pattern"), F.col("id").cast("string").alias("name"), F.col("id").alias("priority"))
    texts = spark.range(2_000).select(F.concat(F.lit("POS SHOP"), (F.col("id") * 9).cast("string"), F.lit("X ARAD")).alias("norm"))
    found = M.pattern_alias(texts, patterns)
    got = {r.norm: r.pattern_name for r in found.collect()}
    assert len(got) == 2_000 and all(n == f"POS SHOP{p}X ARAD" for n, p in got.items())


def test_terms_of_a_batch_equal_all_pairs():
    rng = random.Random(8)
    words = ["rent", "lease", "renta", "casa", "verde", "gas", "energie", "a", "b1", "utilitati", "owners", "association"]
    draw = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))
    terms = [draw(4) for _ in range(30)] + ["", "x" * 70, " ".join(words)]
    texts = [draw(7) for _ in range(300)] + ["z", "x" * 90, "café rent", "  "]
    which, score = TermTable(terms).best(texts)
    for text, w, s in zip(texts, which, score):
        each = [token_set_ratio(text, t) if t else -1.0 for t in terms]
        if text.strip():
            assert s == pytest.approx(max(each)) and w == each.index(max(each)), (text, terms[w], s, max(each))


def test_a_dictionary_of_many_terms(spark):
    table = [("own", f"furnizor {k} nord") for k in range(3_000)]
    texts = spark.createDataFrame([("furnizor 77 nrd",), ("furnizor 2999 nord plata",), ("",)], "t string")
    got = {r.t: (r.term, round(r.score, 2)) for r in T.fuzzy_terms(texts, "t", table).collect()}
    assert got["furnizor 2999 nord plata"] == ("furnizor 2999 nord", 100.0) and got["furnizor 77 nrd"][0] == "furnizor 77 nord" and len(got) == 2
