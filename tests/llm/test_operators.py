"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing names."""

import collections
import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, chat_format, chunk_dedup, decontaminate, jaccard_join, language, line_dedup, quality, secret_scan, substring_exact
from ledgerloom.llm import bytescan as B

DOCS = "doc_id long, text string"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def spans(mask) -> int:
    return sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))


def kept(raw: bytes, mask) -> bytes:
    return bytes(b for b, m in zip(raw, mask) if not m)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_span_hash():
    """Hashes equal the polynomial by big integers; a Thue-Morse text and its complement, which collide modulo any 2^64 base, differ."""
    import numpy as np

    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(70_000), np.uint8)
    hashed, base = B.SpanHash(data), B.base_of(7)
    starts = np.array([rng.randrange(60_000) for _ in range(20)])
    ends = starts + np.array([rng.randrange(2000) for _ in range(20)])
    for a, b, got in zip(starts, ends, hashed(starts, ends)):
        raw = sum((int(data[a + k]) + 1) * pow(base, k, B.PRIME) for k in range(b - a)) % B.PRIME
        assert got == B.mix(np.array([raw], np.uint64) ^ B.mix(np.array([b - a], np.uint64), 3))[0]
    twins = np.frombuffer("".join(THUE).encode(), np.uint8)
    for seed in (7, 8):
        assert len(set(B.SpanHash(twins, seed)(np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 2


def test_span_hash_steps():
    """Spans across the steps of the sums equal the polynomial, and what stays in the process is as small for a long buffer."""
    data = np.frombuffer(random.Random(2).randbytes(70_000) * 60, np.uint8)
    hashed, base = B.SpanHash(data), B.base_of(7)
    assert hashed.inverse.nbytes <= 1 << 18
    for a, b in [(32_767, 32_768), (32_767, 32_769), (32_768, 65_536), (0, 65_536), (30_000, 70_001), (4_199_999, 4_200_000), (4_200_000, 4_200_000)]:
        raw = 0
        for x in data[a:b][::-1].tolist():
            raw = (raw * base + x + 1) % B.PRIME
        assert hashed(np.array([a]), np.array([b]))[0] == B.mix(np.array([raw], np.uint64) ^ B.mix(np.array([b - a], np.uint64), 3))[0]
    a = np.arange(1000, 70_000, 997)
    assert (hashed(a, a + 100_000) == hashed(a + 70_000 * 30, a + 70_000 * 30 + 100_000)).all()


@pytest.mark.parametrize("operator", [line_dedup.line_dedup, chunk_dedup.chunk_dedup, substring_exact.exact_substring_dedup])
def test_packed_texts_are_dealt_out(spark, operator):
    """Packing and the Python step after it are two stages however small the other side: in one, each task would have two workers."""
    passage = "\n".join(f"line {k} of the passage that stands twice in these texts" for k in range(12))
    out = operator(spark.createDataFrame([(1, passage), (2, "head\n" + passage), (3, "other")], DOCS))
    assert out.count() == 3
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) ", plan.split("== Initial Plan ==")[0])
    assert joins[0] == "SortMergeJoin", plan


#: A word of 2048 letters and its complement.
THUE = ["".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(2048)) for flip in (0, 1)]


def test_thue_morse(spark):
    """Twins by any hash modulo a power of two are different texts, lines, words and windows to every operator."""
    one, two = THUE
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one}\n{two}\n{one[:9]}"), (4, f"{two}\n{one}\n{one[:9]}")], DOCS)
    assert [r.n_dup_lines for r in quality.measured(docs).select(F.col("__q_dup_lines").alias("n_dup_lines")).collect()] == [0] * 4
    assert line_dedup.line_dedup(docs).agg(F.sum("__ld_removed")).first()[0] == 0
    hits = decontaminate.report(docs, spark.createDataFrame([("x", one)], "item_id string, text string"))
    assert {r.doc_id: r.n_hit for r in hits.collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    out = substring_exact.exact_substring_dedup(docs, with_bytes=False)
    assert sorted(tuple(r)[:5] for r in out.collect()) == brute_repeats([tuple(r) for r in docs.collect()])


def test_clashing_names(spark):
    """Extra columns pass through the filtering forms, even those of the operators' own names; null ids and texts stay."""
    own = ["__hit_words", "__hit_starts", "__bpe_ids", "__q_words", "__q_kept", "__q_stratum", "__ld_removed", "__ll_rid", "__own_2", "leader", "rid", "starts", "a b", "x.y"]
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, None)], DOCS).withColumn("lang", F.lit("en"))
    docs = docs.withColumns({n: F.lit(f"v{k}") for k, n in enumerate(own)})
    benchmark, labels = spark.createDataFrame([(1, "four")], "item_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = {
        "decontaminate": (decontaminate.decontaminate(docs, benchmark), 3),
        "line_dedup": (line_dedup.without_repeated_lines(docs), 3),
        "one_of_each": (jaccard_join.one_of_each(docs), 2),
        "accepted": (quality.accepted(docs.withColumn("text", F.concat("text", F.lit(" a b c d e f g h")) ), labels), 2),
    }
    for name, (out, n) in kept.items():
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) == n, name
        assert all(list(r)[3:] == [f"v{k}" for k in range(len(own))] for r in rows), name
    for out in (decontaminate.benchmark_hits(docs, benchmark), line_dedup.line_dedup(docs), quality.measured(docs), bpe.encode_documents(docs)):
        assert out.count() == 3 and len(set(out.columns)) == len(out.columns)


# 1


def brute_repeats(rows, size=400):
    seen = collections.Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, r in raws:
        seen.update(r[k : k + size] for k in range(len(r) - size + 1))
    out = []
    for i, r in raws:
        mask = bytearray(len(r))
        for k in range(len(r) - size + 1):
            if seen[r[k : k + size]] > 1:
                mask[k : k + size] = b"\1" * size
        out.append((i, len(r), sum(mask), spans(mask), sha(kept(r, mask))))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [128, 1])
def test_op1(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_exact, "HOT", hot)
    rng = random.Random(1)
    base = prose(rng, 400)
    rows = [(1, "ab" * 900), (2, "x" * 1200), (3, "x" * 400), (4, None), (5, ""), (6, "é" * 700), (7, "ab" * 300), (7, "ab" * 300), (None, "x" * 401)]
    rows += [(10 + k, prose(rng, rng.randrange(50)) + base[rng.randrange(300) : rng.randrange(600, len(base))] + prose(rng, 30)) for k in range(12)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"rid": F.lit(1), "starts": F.lit("x")})
    if hot == 1:  # all in one task, so that it sees several pieces of a key
        df = df.coalesce(1)
        slim = df.filter("text is not null").select(F.lit(b"x").alias("rid"), F.col("text").cast("binary").alias("text"))
        assert slim.mapInArrow(substring_exact._scan(substring_exact.SIZE), substring_exact.RUNS).filter("rid is null").count() > 0
    out = substring_exact.exact_substring_dedup(df)
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == brute_repeats(rows)
    assert substring_exact.exact_substring_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot,passage", [(128, 280), (1, 280), (1, 64), (128, 400)])
def test_op1_passages(spark, monkeypatch, hot, passage):
    """Passages of over 50 words and under 400 bytes are counted and stay; what is removed is the same as without them."""
    monkeypatch.setattr(substring_exact, "HOT", hot)
    rng = random.Random(5)
    shared = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) for n in (51, 60, 66, 67, 90)]
    assert [len(x) for x in shared] == [305, 359, 395, 401, 539]
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(10 * k + j, f"{own(rng.randrange(3, 400))} {x} {own(30 * (j % 2))}".strip()) for k, x in enumerate(shared) for j in range(4)]
    # Repeats that a text's end cuts, inside one text, of one period, and copies; and a long text that repeats nothing.
    rows += [(100, shared[4][:399]), (101, shared[4][-300:]), (102, f"{shared[1]} {own(9)} {shared[1]}"), (103, "ab" * 190), (104, "x" * 281), (105, "x" * 279), (106, None), (107, own(2000))]
    rows += [(108, twin := own(60)), (109, twin), (None, "é" * 150)]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = substring_exact.exact_substring_dedup(df, with_bytes=False, passage=passage).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_repeats(rows)
    assert {r.doc_id: r.n_repeated for r in got} == {i: n for i, _, n, *_ in brute_repeats(rows, passage)}
    if passage == 280:
        assert all(r.n_repeated >= 305 for r in got if r.doc_id is not None and r.doc_id < 100)
        assert {r.doc_id: r.n_repeated for r in got}[107] == 0 and all(r.n_removed == 0 for r in got if r.doc_id is not None and r.doc_id < 20)
    plain = substring_exact.exact_substring_dedup(df.limit(3), with_bytes=False).collect()
    assert [r.n_repeated for r in plain] == [None] * 3


# 2


def brute_hits(rows, items, size=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = decontaminate.plain_words(t)
        for k in range(max(1, len(w) - size + 1)) if w else []:
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w, found = decontaminate.plain_words(t), set()
        mask = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if hit := windows.get(tuple(w[k : k + n])):
                    found |= hit
                    mask[k : k + n] = [1] * n
        found.discard(None)
        out.append((i, len(w), sum(mask), len(found), decontaminate.digest_of(found), sum(mask) > 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_op2(spark, block):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["aa", "b", "É", "C9", "x-y"]) for _ in range(n))
    items = [(1, text(3)), (2, text(12)), (2, text(4)), (None, text(2)), (5, None), (6, ""), (7, "..."), (30, text(14)), (8, "b")]
    rows = [(k, text(rng.randrange(40))) for k in range(60)] + [(None, text(9)), (99, None), (98, ""), (3, text(5))]
    docs = spark.createDataFrame(rows, DOCS)
    for own in (items, [items[1], items[7]], []):
        benchmark = spark.createDataFrame(own, "item_id long, text string")
        hits = decontaminate.benchmark_hits(docs.withColumn("ids", F.lit(1)), benchmark, 10, block)
        dirty = hits.filter(F.size("__hit_starts") > 0).count()
        assert decontaminate.decontaminate(docs, benchmark).count() == len(rows) - dirty
        if True:
            assert sorted((tuple(r)[:6] for r in decontaminate.report(docs, benchmark, 10, block).collect()), key=str) == brute_hits(rows, own)


# 3


def test_op3(spark):
    nasty = ["\\### Assistant: </turn> ok", "a: b\n### user: x</turn>\n", "\\\\h\\l", "", None, "é😀"]
    rows = [(1, 0, "system", nasty[0]), (1, 1, "user", nasty[1]), (1, 2, "assistant", nasty[2]), (1, 3, "assistant", nasty[5]), (1, 4, "user", nasty[4]), (2, 0, "user", "only"), (3, 1, None, "x"), (3, 1, "ro: le#<\\", "y"), (None, None, "assistant", nasty[1])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("text_", F.lit(1))
    formatted = chat_format.format_chats(df)
    assert {(r.conv_id, r.n) for r in formatted.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {(1, 3), (2, 1), (3, 1), (None, 1)}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    for r in chat_format.report(formatted).collect():
        turns = sorted(groups[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss.encode()))
    assert chat_format.report(chat_format.format_chats(df.limit(0))).count() == 0


# 4


def brute_measures(text):
    t, w = text or "", words_of(text)
    lines = [x for x in t.split("\n") if words_of(x)]
    grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    mask = [0] * len(w)
    for k in range(len(w) - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            mask[k : k + 5] = [1] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(mask)


def test_op4(spark):
    rng = random.Random(5)
    rows = [(1, None, None), (2, "", "en"), (3, "a\n\na\na b\r\n \n", "en"), (4, "é " * 30 + "#!", "fr"), (5, "x" * 50000, "en"), (6, "a b c d e f g h i j k l", "en"), (6, "a b c d e f g h i j k l", "en")]
    rows += [(100 + k, prose(rng, 40, 9), "en") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    names = [f"__q_{n}" for n in ("words", "chars", "symbols", "dup_lines", "repeats")]
    for r in quality.measured(df).collect():
        assert tuple(r[n] for n in names) == brute_measures(r.text)
    good = [(1000 + k, prose(rng, 40, 5000), "en") for k in range(400)]
    junk = [(5000 + k, " ".join(w + "%%%" for w in prose(rng, 40, 5000).split()), "en") for k in range(50)]
    few = [(9000 + k, " ".join(w + "%%%" for w in prose(rng, 40, 5000).split()), "xx") for k in range(5)]
    docs = spark.createDataFrame(good + junk + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in junk] + [(7, None, None)], "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    assert ids == {i for i, _, _ in good + few}  # a stratum without labels rejects nothing
    assert quality.accepted(docs.limit(0), labels.limit(0)).count() == 0


def test_exact_bounds():
    assert quality.binomial_tail(0, 100, 0.02) == pytest.approx(0.98**100)
    assert quality.certified([0] * 8, 300, 0.01) == 1.0
    assert quality.certified([0] * 8, 100, 0.01) is None
    assert quality.certified([0, 0, 50, 0, 0, 0, 0, 0], 1000, 0.01) == 6.0


# 5


def test_viterbi():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(15):
        n = int(rng.integers(1, 900))
        scores, resets = rng.normal(size=(n, 3)) * 2, rng.random(n) < 0.01
        resets[0] = True
        v, total = np.zeros(3), None
        for t in range(n):
            v = np.maximum(v, v.max() - (0 if resets[t] else 3.0)) + scores[t]
        path = language.best_path(scores, resets, 3.0)
        total = sum(scores[t][path[t]] for t in range(n)) - sum(3.0 for t in range(1, n) if path[t] != path[t - 1] and not resets[t])
        assert total == pytest.approx(v.max())


def test_op5(spark):
    rng = random.Random(6)
    make = {"aa": ["kat", "tak", "kata", "takka"], "bb": ["mul", "lum", "mulum", "ulum"], "ru": ["мир", "рим", "мири"]}
    text = lambda lang, n: " ".join(rng.choice(make[lang]) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(["aa", "bb", "ru"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("spans", F.lit(1))
    model = language.learn(docs.filter(~language.held_out()))
    held = {r.doc_id for r in docs.filter(language.held_out()).collect()}
    assert held == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    out = language.label_languages(docs, model).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in out if r.doc_id in held)
    mixed = text("aa", 20) + " " + text("bb", 20)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ..."), (4, "“—” 😀"), (5, mixed), (6, mixed), (6, mixed), (7, text("ru", 20000))], DOCS)
    got = {r.doc_id: r for r in language.label_languages(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 7)] == ["und"] * 4 + ["ru"] and got[1].score == 0
    assert [s.lang for s in got[5].spans] == ["aa", "bb"]
    assert {r.lang_pred for r in language.label_languages(odd, language.learn(docs.limit(0))).collect()} == {"und"}
    assert language.label_languages(odd.limit(0), model).count() == 0


def plain_labels(model, text, switch=language.SWITCH):
    """Words, their labels and the document's, by loops over letters and a plain Viterbi pass."""
    import numpy as np

    kinds = [unicodedata.category(c)[0] in "LM" for c in text]
    words = [(a, a + 1 + len(list(g))) for on, g in itertools.groupby(range(len(text)), lambda k: kinds[k]) if on for a in [next(g)]]
    scores = []
    for a, b in words:
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[a:b]).encode() + b"\0"
        grams = [(((raw[k - 2] if k > 1 else 0) << 16 | (raw[k - 1] if k else 0) << 8 | raw[k]) * 2654435761 & 0xFFFFFFFF) >> 16 for k in range(len(raw))]
        script = max(int(language.SCRIPT[x]) for x in raw)
        score = np.sum(model.table[grams], axis=0, dtype=np.float64)
        scores.append(np.where(model.allowed[script], score, language.NEVER))
    v, back = np.zeros(len(model.langs)), []
    for k, e in enumerate(scores):
        best = v.max() - (switch if k else 0)
        back.append(np.where(v >= best, np.arange(len(v)), v.argmax()))
        v = np.maximum(v, best) + e
    label, path = int(v.argmax()), []
    for b in reversed(back):
        path.append(label)
        label = int(b[label])
    return words, path[::-1]


def test_op5_plain(spark):
    """Scores, spans and labels against plain loops, on the registered query's model and on one of 300 languages."""
    import numpy as np

    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzåäößéмирαβγ"
    own = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(6)] for k in range(300)}
    text = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.learn(docs)
    assert len(model.langs) == 300
    names = list(own)
    mixed = [(1000 + k, f"“{text(a, 12)}” — {text(b, 12)}! 😀 {text(a, 5)}") for k, (a, b) in enumerate(rng.sample(names, 2) for _ in range(12))]
    out = {r.doc_id: r for r in language.label_languages(docs.select("doc_id", "text").union(spark.createDataFrame(mixed, DOCS)), model).collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows]) > 0.98
    for i, t in mixed:
        words, path = plain_labels(model, t)
        spans = [(words[g[0]][0], words[g[-1]][1], model.langs[lang]) for lang, run in itertools.groupby(range(len(path)), lambda k: path[k]) for g in [list(run)]]
        assert [tuple(s) for s in out[i].spans] == spans
        mass = collections.Counter()
        for (a, b), lang in zip(words, path):
            mass[model.langs[lang]] += len(t[a:b].encode())
        assert out[i].lang_pred == min(mass, key=lambda x: (-mass[x], x))
        assert out[i].score == pytest.approx(max(mass.values()) / sum(mass.values()))
    with pytest.raises(ValueError):
        language.learn(docs.crossJoin(spark.range(2)).withColumn("lang", F.concat("lang", F.col("id").cast("string"))))


# 6


def shingles(text):
    w = words_of(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(x), least[find(k)]) for k, (i, x) in enumerate(sets))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words) + 1)
        if rng.random() < 0.5 and k < len(words):
            words[k] = f"w{rng.randrange(60)}"
        else:
            words.insert(k, f"w{rng.randrange(60)}")
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 16])
def test_op6(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", block)
    rng = random.Random(7)
    texts = []
    for _ in range(30):
        base = prose(rng, int(2 ** rng.uniform(0, 9))).split()
        texts += [edited(rng, base, rng.randrange(0, 1 + max(1, len(base) // 14))) for _ in range(rng.choice([1, 2, 5]))]
    passage, base = prose(rng, 40), prose(rng, 90).split()
    texts += [prose(rng, rng.randrange(90)) + " " + passage for _ in range(30)]
    texts += [edited(rng, base, rng.randrange(7)) for _ in range(60)]
    texts += [None, "", "One TWO", "one two", " \n", texts[0], texts[0]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(1), "cid": F.lit(2)}).repartition(3)
    got = sorted(tuple(r) for r in jaccard_join.link_documents(df).select("doc_id", "n_shingles", "component_id").collect())
    want = brute_components(rows)
    assert got == want
    if block == 16:
        # Names of 3 bits: nearly all classes share theirs, and are told apart all the same.
        forced = jaccard_join.link_documents(df, bits=3).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(tuple(r) for r in forced) == want
        one = jaccard_join.one_of_each(df)
        assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in want})
        assert one.columns == df.columns
        assert jaccard_join.link_documents(df.limit(0)).count() == 0


# 7 and 8


def test_op7(spark):
    rng = random.Random(8)
    gear = [int(x) >> 32 for x in B.byte_values(31)]

    def chunks(raw):
        out, at, h = [], 0, 0
        for i, b in enumerate(raw):
            h = ((h << 1) + gear[b]) & 0xFFFFFFFF
            n = i + 1 - at
            if (n >= chunk_dedup.LEAST and h >> (32 - chunk_dedup.BITS) == 0) or n == chunk_dedup.MOST:
                out.append((at, i + 1))
                at = i + 1
        if at < len(raw):
            if out and len(raw) - at < chunk_dedup.LEAST:
                out[-1] = (out[-1][0], len(raw))
            else:
                out.append((at, len(raw)))
        return out

    passage = prose(rng, 160)
    rows = [(1, None), (2, ""), (3, "x" * 5000), (4, "ab" * 40), (5, "x" * 5000), (6, "x" * 31), (7, "x" * 31), (8, "five equal copies of a few words"), (9, "five equal copies of a few words")] + [(10 + k, prose(rng, 60) + passage + prose(rng, 9)) for k in range(9)]
    seen, want = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for a, b in chunks(raw):
            if b - a >= chunk_dedup.LEAST or b - a == len(raw):
                if raw[a:b] in seen:
                    mask[a:b] = b"\1" * (b - a)
                seen.add(raw[a:b])
        want.append((i, len(raw), sum(mask), spans(mask), sha(kept(raw, mask))))
    df = spark.createDataFrame(rows + [rows[11]], DOCS).withColumn("rid", F.lit(1))
    got = sorted(tuple(r)[:5] for r in chunk_dedup.chunk_dedup(df).collect())
    assert got == sorted(want + [want[11]])
    assert all(r[2] > 64 for r in got if r[0] > 10)  # all but the first lose chunks of the passage
    assert chunk_dedup.chunk_dedup(df.limit(0)).count() == 0


def test_op8(spark):
    rows = [(1, None), (2, ""), (3, "a\nb\nc\nd"), (4, "x\na\nb\nc"), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, "a\nb\nc"), (8, "p\np\np\np\np"), (9, "é\nü\na\nb\nc\nd\nz"), (9, "é\nü\na\nb\nc\nd\nz")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"starts": F.lit(1), "a": F.lit(2)})
    out = sorted(((r.doc_id, r.text, r["__ld_removed"]) for r in line_dedup.line_dedup(df).collect()), key=str)
    want = [(1, None, 0), (2, "", 0), (3, "a\nb\nc\nd", 0), (4, "x", 3), (5, "\n\n\n\n", 0), (6, "\n\n\n\n", 0), (7, "", 3), (8, "p", 4), (9, "é\nü\nz", 4), (9, "é\nü\nz", 4)]
    assert out == sorted(want, key=str)
    assert line_dedup.without_repeated_lines(df).columns == df.columns
    assert line_dedup.without_repeated_lines(df).count() == 9
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


# 9


def base_spans(text):
    """Spans by form: start, rank, stop and kind, in order."""
    want = []
    for rank, (kind, (pattern, least)) in enumerate(secret_scan.KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(2) if kind == "assign" else m.group(0)) >= least:
                want.append((m.start(), rank, m.end(), kind))
    return sorted(want)


def test_op9(spark):
    rng = random.Random(4)
    some = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    alnum = letters + letters.upper() + "0123456789"
    key = some(alnum, 40)
    rows = [(1, None), (2, ""), (3, 'é password : "abc" token=token: abcdefg token=token=abcdefg PassWD=12345'), (4, "AKIA" + "AKIA" * 8 + " x AKIA1 " + "ab" * 20), (5, f"😀 key {key} end"), (6, "internationalization/globalization-and-standardization_of_words"), (7, "a" * 5000), (8, "secret=" * 200 + "abcdef"), (8, "secret=" * 200 + "abcdef")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"base": F.lit(1), "spans": F.lit(2)})
    texts = dict(rows)
    for r in secret_scan.find_secrets(df).collect():
        assert [tuple(x) for x in r.base] == base_spans(texts[r.doc_id])
        found = [texts[r.doc_id][s.start : s.stop] for s in r.spans if s.kind == secret_scan.FOUND]
        assert found == ([key] if r.doc_id == 5 else [])
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


# 10


def test_op10(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(5)
    alphabet = ["a", "b", "e", "th", "in", " ", "  ", "\n", "\t", "é", "ß", "漢", "😀", "1", "23", "'s", "'", "<|endoftext|>", "<|", "!!!", "aaaaaaa", "\x00", "Ā", "\r", "ﬁ", "İ"]
    strange = lambda: chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x10000, 0x11000)]))
    texts = ["".join(rng.choice(alphabet) if rng.random() < 0.7 else strange() for _ in range(rng.randrange(40))) for _ in range(400)] + ["word " * 20000, "", None, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_tokens", F.lit(1))
    for r in bpe.encode_documents(df).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(r["__bpe_ids"])).cast("I")) == ids
        assert r["__bpe_decoded"] == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("often", [0, 5, 40])
def test_linked_sets_share_a_part(often):
    """Pairs that link by removing and adding shingles share a dealt part, whichever shingles count as frequent; sets that can link with nothing deal none."""
    rng = random.Random(often)
    everything = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)
    frequent = np.sort(everything[:often])
    deal = lambda sets: (lambda p, o: [set(p[o == k].tolist()) for k in range(len(sets))])(*jaccard_join.part_sketches(np.concatenate([np.sort(np.array(sorted(s), np.uint64)) for s in sets]), np.cumsum([0, *map(len, sets)]), frequent))
    linked = 0
    for _ in range(1500):
        a = set(rng.sample(everything.tolist(), rng.randint(1, 24)))
        b = set(rng.sample(sorted(a), len(a) - rng.randint(0, min(3, len(a) - 1)))) | set(rng.sample(everything.tolist(), rng.randint(0, 3)))
        if a != b and 4 * len(a & b) >= 3 * len(a | b):
            linked += 1
            x, y = deal([a, b])
            assert x & y, (a, b)
    assert linked > 300
    assert deal([{int(v)} for v in everything]) == [set()] * 60 and deal([set(everything[:2].tolist())]) == [set()]


def test_short_sets_of_frequent_shingles_form_no_group():
    """16000 different sets of one to eight frequent shingles: few deal a part with nothing in it."""
    rng = np.random.default_rng(1)
    frequent = np.sort(rng.integers(0, 1 << 63, 1 << 16).astype(np.uint64))
    sizes = np.arange(16_000) % 8 + 1
    sets = [np.sort(rng.choice(frequent, n, replace=False)) for n in sizes]
    first = np.concatenate([[0], np.cumsum(sizes)])
    prints, owner = jaccard_join.part_sketches(np.concatenate(sets), first, frequent)
    assert not np.isin(sizes[owner], (1, 2)).any()
    _, together = np.unique(prints, return_counts=True)
    assert (together**2).sum() < 16_000**2 / 100  # the share of all pairs that the groups hold
