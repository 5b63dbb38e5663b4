"""Blocking by common tokens: the same firms as over all pairs, from a bounded number of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import industry as J
from ledgerloom.operators import merchants as M

from .test_similar import heads, name_tokens, registry_name

WORDS = ["MOLID", "MOLIDUL", "ZORI", "ZORILE", "NORD", "SUD", "EST", "COMERT", "COMERCIAL", "CARREFOUR", "CARREF", "MEGA", "MEGAIMAGE", "TRANS", "TRANSPORT", "LUX"]


def names(seed, n, most=4):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS[: rng.choice([4, 16])]) for _ in range(rng.randint(1, most))) for _ in range(n)]


def brute_block(query, firms, most):
    tokens = name_tokens(registry_name(query))
    important = sorted(tokens, key=lambda t: (t[:4] not in M.R.BRAND_PREFIXES, -len(t), tokens.index(t)))[:3]
    found = []
    for i, name in firms:
        own = name_tokens(registry_name(name))
        score = sum(3 * (t in own) for t in important) + sum(len(t) >= 4 and len(o) >= 4 and t[:4] == o[:4] for t in important for o in own)
        if score:
            found.append((-score, i))
    return [(i, -s, k) for k, (s, i) in enumerate(sorted(found)[:most], 1)]


@pytest.mark.parametrize("common,most", [(0, 3), (2, 5), (12, 4), (10**6, 5)])
def test_blocking_equals_all_pairs(spark, common, most):
    firms = list(enumerate(names(1, 150)))
    texts = sorted(set(names(2, 60, 6)))
    reg = M.registry(spark.createDataFrame(firms, "firm_id long, name string"))
    queries = M.registry_queries(spark.createDataFrame([(t,) for t in texts], "q string"), "q")
    got = {}
    for r in M.blocking_scores(queries, reg, most, common).collect():
        got.setdefault(r.query, []).append((r.firm_id, r.block_score, r.block_rank))
    want = {t: brute_block(t, firms, most) for t in texts}
    assert {t: sorted(v, key=lambda x: x[2]) for t, v in got.items()} == {t: v for t, v in want.items() if v}


def brute_best(query, firms, least=0.5):
    norm = registry_name(query)
    bare = lambda n: list(dict.fromkeys(t for t in (x.strip(".-") for x in n.split(" ")) if len(t) >= 3 and not t.isdigit()))
    tokens, best = bare(norm), None
    for i, name in firms:
        own_norm = registry_name(name)
        own = bare(own_norm)
        if not set(tokens) & set(own) and not heads(tokens) & heads(own):
            continue
        overlap = max(1, len(set(tokens) & set(own)))
        score = 0.65 * (overlap / len(tokens)) + 0.35 * (overlap / max(1, len(own)))
        if norm in own_norm:
            score = max(score, 0.97)
        if best is None or (score, -i) > best:
            best = (score, -i)
    return (-best[1], best[0]) if best and best[0] >= least else None


@pytest.mark.parametrize("common", [0, 2, 12, 10**6])
def test_best_firm_equals_all_pairs(spark, common):
    firms = list(enumerate([*names(3, 150, 6), "SA", "ZORIL EST SUDUL", "NORDZORI ESTIC"]))
    texts = sorted({*names(4, 60), "ZORI EST", "ORI", "MEGA", "X", "EST SUD"})
    got = {r.query: (r.firm_id, pytest.approx(r.score)) for r in J.best_firm(spark.createDataFrame([(t,) for t in texts], "query string"), spark.createDataFrame(firms, "firm_id long, name string"), common=common).collect()}
    want = {t: brute_best(t, firms) for t in texts}
    assert got == {t: v for t, v in want.items() if v}


def test_a_token_of_a_third_of_all_firms(spark):
    """30,000 firms of which every third is called MOLID, 300 queries with that token: pairs stay under 150 a query times 3, not 10,000."""
    firms = spark.range(30_000).select(F.col("id").alias("firm_id"), F.concat(F.when(F.col("id") % 3 == 0, "MOLID ").otherwise("ALTA "), F.concat(F.lit("FIRMA"), F.col("id").cast("string"))).alias("name"))
    texts = spark.range(300).select(F.concat(F.lit("MOLID FIRMA"), (F.col("id") * 7).cast("string"), F.lit(" ORADEA")).alias("query"))
    reg, queries = M.registry(firms), M.registry_queries(texts, "query")
    assert M.blocking_pairs(queries, reg).count() <= 300 * 3 * 150
    scores = M.blocking_scores(queries, reg).filter("block_rank = 1").collect()
    assert len(scores) == 300 and all(r.firm_id == int(r.query.split("FIRMA")[1].split()[0]) for r in scores if int(r.query.split("FIRMA")[1].split()[0]) % 3 == 0)
    best = J.best_firm(texts, firms).collect()
    assert {r.query for r in best if r.score > 0.6} >= {f"MOLID FIRMA{k * 7} ORADEA" for k in range(300) if k * 7 % 3 == 0}
