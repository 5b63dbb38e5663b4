"""Op 9's added spans: the statistics against plain Python, planted secrets of other kinds, and texts of very many matches."""

import itertools
import math
import random
import time

from pyspark.sql import functions as F

from ledgerloom.llm import secret_scan as S

ALPHABETS = {e[0]: e[2] for e in S.ENCODINGS}


def plain(hit: str) -> dict:
    """What ``measured`` gives, by loops."""
    import re

    bare = hit.rstrip("=")
    bare = bare.replace("-", "") if re.search(S.GROUPS, bare) else bare
    name = next((e[0] for e in S.ENCODINGS if e[1] and re.search(e[1], bare)), S.ENCODINGS[-1][0])
    a = ALPHABETS[name]
    x, n, k = [a.index(c) for c in bare], len(bare), len(a)
    counts = [bare.count(c) for c in set(bare)]
    mean, middle = sum(x) / n, (k - 1) / 2
    side = [S.classes_of(a)[v] for v in x]
    return {
        "encoding": name,
        "k": k,
        "n": n,
        "twos": sum(c * (c - 1) for c in counts),
        "threes": sum(c * (c - 1) * (c - 2) for c in counts),
        "squares": sum(side.count(c) ** 2 for c in S.CLASSES),
        "cubes": sum(side.count(c) ** 3 for c in S.CLASSES),
        "changes": sum(p != q for p, q in itertools.pairwise(side)),
        "lagged": sum((p - mean) * (q - mean) for p, q in itertools.pairwise(x)),
        "spread": sum((v - mean) ** 2 for v in x),
        "along": sum((p - middle) * (q - middle) for p, q in itertools.pairwise(x)) * 12 / (k * k - 1),
    }


def test_statistics(spark):
    rng = random.Random(3)
    hits = ["0" * 20, "20240131123059123456", "deadbeef" * 3, "Z" * 24, "a", "aB3+/-_" * 4 + "==", "qwertyuiopasdfghjklzxcvbnm", "1b4e28ba-2fa1-11d2-883f-0016d3cca427", "1B4E-28BA", "1b4e-28BA"]
    hits += ["".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randrange(1, 70))) for name in ALPHABETS for _ in range(4)]
    for r in S.measured(spark.createDataFrame([(h,) for h in hits], "hit string")).collect():
        want = plain(r.hit)
        assert r.encoding == want.pop("encoding")
        assert all(math.isclose(r[c], v, abs_tol=1e-6) for c, v in want.items()), r


def planted(rng):
    """Texts, planted secrets and natural long strings (numbers, names in code, paths, compounds, identifiers)."""
    syllables = ["lich", "ein", "tion", "ver", "ung", "ber", "sta", "keit", "ing", "the", "ment", "ous", "ar", "el"]
    word = lambda low, high: "".join(rng.choice(syllables) for _ in range(rng.randrange(low, high)))
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    secrets = [some(ALPHABETS[name], n) for name in ("base62", "base32", "lower36") for n in (24, 32, 40, 48, 64) for _ in range(8)]
    secrets += [some(ALPHABETS["base62"] + "+/", n) + "==" for n in (22, 44) for _ in range(8)]
    natural = ["".join(word(1, 3).title() for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    natural += ["_".join(word(1, 4) for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    natural += ["/".join(word(1, 3) for _ in range(rng.randrange(4, 9))) + "/v2" for _ in range(150)]
    natural += [word(6, 12) for _ in range(150)] + [f"2024{k:02d}01-{k * 60:06d}-000{k:03d}-{word(2, 4)}" for k in range(100)]
    natural += ["1" * 20 + str(k) for k in range(50)] + ["=" * 3 + "-" * (20 + k) for k in range(30)]
    texts = [" ".join([*(word(1, 6) for _ in range(40)), x, *(word(1, 6) for _ in range(40))]) for x in secrets + natural]
    return texts, {s for s in secrets if not S_BASE(s)}


def S_BASE(text: str) -> bool:
    import re

    return any(re.search(p, text) for p in S.LONG_ENOUGH.values())


def test_planted(spark):
    """Recall of planted secrets is 0.95 from 40 characters on and 0.65 in all, and at most one in 20 of what is found is none."""
    texts, secrets = planted(random.Random(11))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = S.find_secrets(df).select("doc_id", F.explode("spans").alias("s")).filter(F.col("s.kind") == S.FOUND).collect()
    hits = {texts[r.doc_id][r.s.start : r.s.stop] for r in found}
    right, long = len(hits & secrets), {s for s in secrets if len(s) >= 40}
    assert right >= 0.65 * len(secrets) and len(hits & long) >= 0.95 * len(long)
    assert len(hits) - right <= 0.05 * len(hits)


def test_many_matches(spark):
    text = "secret=abcdef12 " * 30_000
    df = spark.createDataFrame([(1, text), (2, text), (2, text)], "doc_id long, text string")
    S.find_secrets(df.limit(1)).count()
    began = time.time()
    rows = S.find_secrets(df).collect()
    assert len(rows) == 3 and all(len(r.base) == 30_000 for r in rows)
    assert [tuple(s) for s in rows[0].base[:2]] == [(0, 0, 15, "assign"), (16, 0, 31, "assign")]
    assert time.time() - began < 30


def test_long_strings(spark):
    """Random strings of 64 symbols stay random at any length; identifiers in groups of 32 digits tell too little to be found, and no natural string is."""
    rng = random.Random(21)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    secrets = [some(ALPHABETS[name], n) for name in ("base64", "base64url") for n in (1000, 2000, 4000) for _ in range(20)]
    groups = ["-".join(some(ALPHABETS["hex"], n) for n in (8, 4, 4, 4, 12)) for _ in range(40)]
    natural = planted(random.Random(5))[0][136:]
    texts = [f"see {x} there" for x in secrets + groups] + natural
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = S.find_secrets(df).select("doc_id", F.explode("spans").alias("s")).filter(F.col("s.kind") == S.FOUND).collect()
    # A run may stop at a sign that borders of candidates do not take; what counts is that its text has a span.
    hit = {r.doc_id for r in found}
    assert sum(k in hit for k in range(120)) >= 118
    assert sum(k >= 160 for k in hit) <= 0.05 * len(hit)


def test_discoveries_by_plain_rule(spark):
    """The step-up rule on classes of p-values, class of lengths by class of lengths."""
    rng = random.Random(9)
    rows = [(k, float(rng.choice([22, 30, 50, 90])), 10 ** -rng.uniform(0, 6) if rng.random() < 0.5 else rng.random()) for k in range(400)] + [(999, 22.0, 0.0)]
    got = {r.id for r in S.discoveries(spark.createDataFrame(rows, "id long, n double, p_natural double")).collect()}
    want = set()
    for low, high in itertools.pairwise([0, *S.LENGTH_CLASSES, 10**9]):
        own = [(i, min(300, max(0, math.floor(-10 * math.log10(max(p, 1e-300)))))) for i, n, p in rows if low <= n < high]
        bins = [b for _, b in own]
        good = [b for b in set(bins) if len(own) * 10 ** (-b / 10) / sum(x >= b for x in bins) <= S.SHARE]
        want |= {i for i, b in own if good and b >= min(good)}
    assert got == want and len(want) > 50


def test_natural_model_by_loops(spark):
    words = ["keitverung", "lichkeit_ung", "Stationen12", "v2/tion/ment", "deadbeefcafe", "staberung"] * 3 + ["ABCDEFGHIJKLM"]
    got = {r.encoding: r for r in S.natural_model(spark.createDataFrame([(w,) for w in words], "hit string")).collect()}
    for name, _, _, two0, change0 in S.ENCODINGS:
        own = [p for p in map(plain, words) if p["encoding"] == name]
        pairs, steps = sum(p["n"] * (p["n"] - 1) for p in own), sum(p["n"] - 1 for p in own)
        m = S.PRIOR_WORDS
        two = (sum(p["twos"] for p in own) + two0 * 210 * m) / (pairs + 210 * m)
        change = (sum(p["changes"] for p in own) + change0 * 14 * m) / (steps + 14 * m)
        wild = sum((p["changes"] - change * (p["n"] - 1)) ** 2 for p in own)
        serial = sum(p["along"] for p in own) / (steps + 14 * m)
        rough = sum((p["along"] - serial * (p["n"] - 1)) ** 2 for p in own)
        r = got[name]
        assert math.isclose(r.two, two) and math.isclose(r.change, change) and math.isclose(r.serial, serial, abs_tol=1e-9)
        assert math.isclose(r.over, max(1.0, (wild + 14 * m) / (steps * change * (1 - change) + 14 * m)), rel_tol=1e-9)
        assert math.isclose(r.serial_sd, math.sqrt((rough + 14 * m) / (steps + 14 * m)), rel_tol=1e-9)
