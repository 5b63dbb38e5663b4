"""Periodic runs, main texts and centroids: against plain Python, on planted cases, and as registered over the tables."""

import hashlib
import html
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__
from ledgerloom.llm import centroids as C
from ledgerloom.llm import periodic_runs as P
from ledgerloom.llm.main_text import extract, main_text
from ledgerloom.llm.suffix import common_prefixes, suffix_array

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def read(name, columns):
    path = f"{DATA}/{name}.parquet"
    return duckdb.sql(f"select {columns} from '{path if os.path.isfile(path) else path + '/*.parquet'}'").fetchall()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def brute_runs(words, least=6, power=4):
    """Each stretch of equal words q apart, smallest q first; a stretch seen with a smaller q is the same run."""
    seen = {}
    for q in range(1, len(words) // power + 1):
        k = 0
        while k + q < len(words):
            end = k
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > k and end + q - k >= max(least, power * q):
                seen.setdefault((k, end + q), q)
            k = max(end, k + 1)
    return sorted(((a, b, q) for (a, b), q in seen.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(words)
    gone = {k for a, b, q in runs for k in range(a + q, b)}
    top = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    first = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def drawn_words(rng):
    letters = rng.choice([1, 2, 2, 3, 4])
    if rng.random() < 0.4:
        return [rng.randrange(letters) for _ in range(rng.randint(0, 120))]
    words = []
    for _ in range(rng.randint(1, 8)):
        words += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        at = rng.randrange(len(words))
        words += words[at : at + rng.randint(0, 40)]
    return words


@pytest.mark.parametrize("least,power", [(6, 4), (6, 5), (9, 4), (20, 4)])
def test_runs_equal_all_periods(least, power):
    rng = random.Random(least * power)
    for _ in range(400):
        words = drawn_words(rng)
        assert P.runs(np.array(words, np.int64), least, power) == brute_runs(words, least, power), words


def test_suffixes_of_long_segments():
    rng = random.Random(5)
    for _ in range(300):
        words = rng.choice([drawn_words(rng), list(range(rng.randint(1, 40))) * rng.randint(1, 4), [3] * rng.randint(0, 50)])
        order = sorted(range(len(words)), key=lambda k: words[k:])
        assert list(suffix_array(np.array(words, np.int64))) == order
        same = [next((k for k in range(len(words)) if words[a + k : a + k + 1] != words[b + k : b + k + 1] or max(a, b) + k >= len(words)), 0) for a, b in zip(order, order[1:])]
        assert common_prefixes(np.array(words, np.int64), np.array(order, np.int64)).tolist() == [0, *same][: len(words)]


def test_long_periodic_texts_are_linear():
    assert P.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert P.runs(np.arange(200_000) % 40_000) == [(0, 200_000, 40_000)]


def test_texts_of_a_block_stay_apart(spark):
    rows = [(1, "a b " * 4, 7), (2, "a b " * 4, 8), (3, None, 9), (4, "", 9), (5, " \t\n\v\f\r ", 9), (6, "x", 9), (1, "a b " * 4, 7), (None, "c " * 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __pr_start long").coalesce(1)
    got = sorted(((r.doc_id, [tuple(x) for x in r["__pr_runs"]], r["__pr_collapsed"], r["__pr_start"]) for r in P.periodic_runs(docs).collect()), key=str)
    two = [(0, 8, 2)]
    assert got == sorted([(1, two, "a b", 7), (2, two, "a b", 8), (3, [], "", 9), (4, [], "", 9), (5, [], "", 9), (6, [], "x", 9), (1, two, "a b", 7), (None, [(0, 9, 1)], "c", 0)], key=str)
    assert P.periodic_runs(docs.limit(0)).collect() == []


def test_a_long_text_among_short_ones(spark, monkeypatch):
    rng = random.Random(2)
    long = " ".join(rng.choice(["a", "b", "c"]) for _ in range(3000)) + " z" * 50
    numbers, words = P._word_numbers(long.encode(), 10)
    monkeypatch.setattr(P, "PIECE", 64)
    assert P._word_numbers(long.encode(), 10) == (numbers, words) and [words[k - 10].decode() for k in numbers] == long.split()
    docs = spark.createDataFrame([(1, "q"), (2, long), (3, "z " * 7)], "doc_id long, text string")
    assert {r.doc_id: [(a, a + n, q) for a, n, q in r["__pr_runs"]] for r in P.periodic_runs(docs).collect()} == {1: [], 2: brute_runs(long.split()), 3: [(0, 7, 1)]}


@tables
def test_op11(spark):
    got = [tuple(r) for r in __spark_entry__.queries()["op11_periodic_runs"](spark, DATA).collect()]
    assert sorted(got, key=str) == sorted((brute_row(*r) for r in read("documents", "doc_id, text")), key=str)


# Main texts

LONG = "This paragraph is long enough to count, has commas, and carries the article on; it goes on for a while."
CASES = {
    "menus and boxes by class": (
        f"<body><div class=header><h1>Site</h1></div><div id=menu><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><div class='content'><h1>T</h1><p>{LONG}<p>{LONG}<p>Short.<ul><li>one<li>two <a href=x>link</a></ul>"
        f"</div><div class=side><p>Side text.</p></div><div id=footer>c</div>",
        ["T", LONG, LONG, "Short.", "one", "two link"],
    ),
    "longer comments than article": (f"<main><article><header><h1>T</h1></header><section><p>{LONG}</p></section><section><p>{LONG} {LONG}</p><p>ok</p></section><footer>tags</footer></article><section id=comments><article><p>{LONG * 9}</p></article></section></main>", ["T", LONG, f"{LONG} {LONG}", "ok"]),
    "notices, adverts, forms": (f"<div class='cookie-notice'><p>{LONG * 5}</p></div><article class='post has-sidebar'><p>{LONG}</p><aside>x</aside><div class=ad>Buy</div><form><input><label>mail</label></form></article>", [LONG]),
    "cells left open": (f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table><p>after</article>", [LONG, "a", "b", "c", "after"]),
    "cut inside a tag": (f"<article><p>{LONG}</p><p>half <a href='x", [LONG, "half"]),
    "cut inside a comment": (f"<article><p>{LONG}</p><p>half <!-- x", [LONG, "half"]),
    "marks in attributes and scripts": (f"<script>var a='<p>no</p>';</script><style>p > a{{}}</style><article><p title='a>b' x=\"</p>\">{LONG} a < b &amp;&lt;&eacute;&#233;&nbsp;x&amp</p></article>", [f"{LONG} a < b &<éé x&"]),
    "white space and line breaks": (f"<article>\n <p>a\t b<br>c\n\n<i>d</i>e </p> bare  text <h2> h </h2><p>{LONG}</p></article>", ["a b c de", "bare text", "h", LONG]),
    "containers side by side": ("<div id=c>" + "".join(f"<h2>H{k}</h2><div><p>{' '.join([LONG] * (k + 1))}</p></div>" for k in range(3)) + "</div><div>c 2020</div>", [x for k in range(3) for x in (f"H{k}", " ".join([LONG] * (k + 1)))]),
    "a form around the page": (f"<form><div><p>{LONG}</p></div></form><p>c 2020</p>", [LONG]),
    "a menu without a name": (f"<article><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Sport</a></div><p>{LONG}</p><p><a href=1>Only a link</a></p></article>", [LONG, "Only a link"]),
    "buttons and small adverts in a line": (f"<article><p>{LONG} <button>Share</button>end<span class=ad> BUY</span></p></article>", [f"{LONG} end"]),
    "only short blocks": ("<nav>n</nav><article><p>Yes.</p></article><div>no</div>", ["Yes."]),
    "nothing": ("<nav>only a menu</nav>", []),
}


@pytest.mark.parametrize("case", CASES)
def test_main_text_of(case):
    page, lines = CASES[case]
    assert main_text(page)[0].split("\n") == (lines or [""])


def test_depth_and_stray_ends():
    for page in ("<div>" * 50_000 + LONG, "<b>" * 50_000 + LONG + "</i>" * 50_000, "</p>" * 50_000 + LONG, "<p><a href=x>" * 20_000 + LONG, "<table><tr><td>" * 20_000 + LONG):
        assert main_text(page)[0] == LONG


def test_pages_edges(spark):
    rows = [(1, "u", f"<article>{LONG}</article>", "m"), (2, "u", None, "m"), (3, None, "", "m"), (1, "u", f"<article>{LONG}</article>", "m"), (None, "u", "<", "m")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, __mt_names string"))
    assert sorted((str(r.page_id), r["__mt_text"], r["__mt_names"]) for r in got.collect()) == [("1", LONG, "m"), ("1", LONG, "m"), ("2", "", "m"), ("3", "", "m"), ("None", "<", "m")]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def article_of(page):
    """What the tables' pages hold between the marks of their article."""
    inside = re.search(r"<article>(.*)</article>", re.sub(r"<script>.*?</script>", "", page or "", flags=re.S), re.S)
    parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", inside[1].replace("<br>", " "))) if inside else []
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


@tables
def test_op12(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in __spark_entry__.queries()["op12_main_text"](spark, DATA).collect()}
    assert got == {i: (url, article_of(page), len(article_of(page))) for i, url, page in read("pages", "page_id, url, html")}


# Centroids


def brute_clusters(vectors, clusters=C.CLUSTERS, rounds=C.ROUNDS):
    """vectors: pairs of vec_id and integers. Rows as the query gives them."""
    order = sorted(vectors, key=lambda v: (sha(f"{C.SEED}:{'' if v[0] is None else v[0]}"), v[1]))
    centroids = [list(v) for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = [[v for _, v in vectors if near(v)[1] == k] for k in range(len(centroids))]
        centroids = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centroids)]
    rows = [(i, near(v)[1], near(v)[0]) for i, v in vectors]
    inertia = [sum(d for _, c, d in rows if c == k) for k in range(len(centroids))]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, centroids[c])))) for i, c, d in rows), key=str)


def test_centroids_equal_full_distances(spark):
    rng = random.Random(1)
    point = lambda: [rng.choice([-2.0, -0.0005, 0.0, 0.25, 1.0]) if rng.random() < 0.9 else rng.uniform(-3, 3) for _ in range(64)]
    rows = [(k, point(), "x") for k in range(60)]
    rows += rows[:5] + [(None, point(), "x"), (7, point(), "x")]  # repeated rows, a null id, an id with two vectors
    odd = [(90, None, "x"), (91, [], "x"), (92, [1.0] * 63, "x"), (93, [1.0] * 65, "x"), (94, [None] + [1.0] * 63, "x"), (95, [float("nan")] * 64, "x"), (96, [float("inf")] + [0.0] * 63, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster string").repartition(3)
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows]
    got = C.clustered(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(kept)
    model = C.fit(df)
    wide = C.assigned(df, model)
    assert wide.columns == ["vec_id", "embedding", "cluster", "__km_cluster", "__km_distance"] and wide.count() == len(rows)
    assert C.clustered(df.limit(0)).collect() == [] and C.fit(df.filter("vec_id >= 90")) is None
    few = C.clustered(df.filter("vec_id in (11, 12)")).collect()
    assert sorted((r.cluster, r.distance, r.inertia) for r in few) == [(0, 0, 0), (1, 0, 0)]
    with pytest.raises(Exception, match="beyond"):
        C.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


def test_partial_distances_are_full_ones():
    rng = np.random.default_rng(4)
    points, centers = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (8, 64))
    centers[5] = centers[2]
    full = ((points[:, None, :] - centers[None]) ** 2).sum(2)
    for step in (1, 8, 64):
        which, best = C.nearest(points, C.Model(centers, rng.permutation(64)), step)
        assert (best == full.min(1)).all() and (which == full.argmin(1)).all()
