"""Queries by similarity, which SQL does not have, against loops over all pairs."""

import os
import re

import pytest

from ledgerloom import rules as R
from ledgerloom.functions.similarity import sequence_ratio, token_set_ratio
from ledgerloom.operators import merchants as M
from ledgerloom.operators import transfers as T
from ledgerloom.plans import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def registry_name(text):
    return re.sub(r"\s+", " ", re.sub(r"[^A-Z0-9\s&.-]", " ", text.upper())).strip()


def name_tokens(norm):
    bare = [t.strip(".-") for t in norm.split(" ")]
    kept = [t for t in bare if len(t) >= 3 and not t.isdigit() and t not in R.LEGAL_SUFFIXES and t.lower() not in R.STOPWORDS]
    return list(dict.fromkeys(kept))


def heads(tokens):
    return {t[:4] for t in tokens if len(t) >= 4}


def best_firm(query, firms):
    """The fold over the firms as the registry's rules say it, for one text."""
    norm = registry_name(query)
    tokens = name_tokens(norm)
    if not tokens:
        return None
    known = [(i, name.strip(), registry_name(name), name_tokens(registry_name(name))) for i, name in sorted(firms)]
    known = [f for f in known if f[3]]
    for same in (lambda f: f[2] == norm, lambda f: sorted(f[3]) == sorted(tokens)):
        if found := next((f for f in known if same(f)), None):
            return found[1], 100.0
    important = sorted(tokens, key=lambda t: (t[:4] not in R.BRAND_PREFIXES, -len(t), tokens.index(t)))[:3]
    block = []
    for f in known:
        score = sum(3 * (t in f[3]) for t in important) + sum(len(t) >= 4 and len(o) >= 4 and t[:4] == o[:4] for t in important for o in f[3])
        if score:
            block.append((-score, f[0], f))
    best = (0.0, None, None)
    for _, _, (_, display, firm, own) in sorted(block)[: R.REGISTRY_CANDIDATES]:
        bonus = sum(8.0 if t in own else 6.0 if len(t) >= 4 and t[:4] in heads(own) else 0.0 for t in important)
        if not bonus:
            continue
        foreign = sum(t not in tokens and not (len(t) >= 4 and t[:4] in heads(tokens)) for t in own)
        centred = len(heads(own) & heads(tokens) & set(R.BRAND_PREFIXES))
        special = (min(6.0, 8.0 * centred / len(own)) if centred else 0.0) - 2.2 * foreign
        base = max(token_set_ratio(norm, firm), token_set_ratio(" ".join(important), firm))
        score = max(0.0, min(100.0, base + bonus + special))
        if any(t not in own and len(t) >= 4 and t[:4] in heads(own) and t[:4] in R.BRAND_PREFIXES for t in important):
            score = max(score, 82.0)
        if score > best[0] + 1e-9 or (best[2] is not None and abs(score - best[0]) <= 0.5 and (foreign < best[1] or (foreign == best[1] and display < best[2]))):
            best = (score, foreign, display)
    return (best[2], round(best[0], 4)) if best[2] is not None and best[0] >= R.REGISTRY_LEAST else None


def test_registry(spark):
    firms = [(r.firm_id, r.name) for r in Q.firms(spark, DATA).collect()]
    texts = [r.query for r in Q.wanted(spark, DATA).collect()]
    want = {q: best_firm(q, firms) for q in texts}
    got = {r.query: (r.display, r.score) for r in Q.q_registry_fuzzy(spark, DATA).collect()}
    assert set(got) == {q for q, w in want.items() if w}
    for q, (display, score) in got.items():
        assert display == want[q][0] and score == pytest.approx(want[q][1], abs=1e-4)


def test_fuzzy_alias(spark):
    aliases = [(r.alias, r.name) for r in M.alias_table(spark).collect()]
    extra = [(x,) for x in ("MEGA IMAG", "CARREFUR", "AUCHAM", "A", "", "KAUFLAN SRL")]
    texts = Q.norms(spark, DATA).select("norm").union(spark.createDataFrame(extra, "norm string")).distinct()
    for least in (0.6, R.FUZZY_ALIAS_LEAST):
        want = {}
        for (text,) in texts.collect():
            words = {w for w in text.split(" ") if len(w) >= 4}
            near = [a for a in aliases if words & set(a[0].split(" "))]
            pool = near if len(near) >= 8 else aliases
            if pool and text:
                score, name = min((-sequence_ratio(text, a), n) for a, n in pool)
                if -score >= least:
                    want[text] = (name, pytest.approx(-score))
        got = {r.norm: (r.fuzzy_name, r.fuzzy_score) for r in M.fuzzy_alias(texts, M.alias_table(spark), least).collect()}
        assert got == want


def test_fuzzy_terms(spark):
    table = [(c, T.normalised(t)) for c, rule in R.TRANSFER_TERMS.items() if rule["fuzzy"] for t in T.terms_of(c)]
    for r in Q.q_fuzzy_terms(spark, DATA).collect():
        best = max(token_set_ratio(r.text, t) for _, t in table if t)
        assert r.score == pytest.approx(best)
        assert (r.category, r.term) == next((c, t) for c, t in table if t and token_set_ratio(r.text, t) == best)


def test_normalised_by_registry(spark):
    """Every row's outcome follows from its text alone: registry first but for gateways, then aliases, else its own first spelling."""
    rows = Q.q_normalise_registry(spark, DATA).join(Q.typed(spark, DATA).select("seq", "merchant_raw"), "seq").collect()
    firms = [(r.firm_id, r.name) for r in Q.registry_of_merchants(spark, DATA).collect()]
    sources = {}
    for r in rows:
        if not r.merchant_raw:
            assert r.normalization_source is None
            continue
        sources.setdefault(r.merchant_raw, set()).add((r.merchant_canonical, r.normalization_source, r.confidence))
    assert all(len(s) == 1 for s in sources.values())
    for raw, ((_, source, confidence),) in sources.items():
        norm = re.sub(r"\s+", " ", re.sub(r"[^A-Z0-9*./&\s-]", " ", raw.upper())).strip()
        found = best_firm(norm, firms)
        if "PAYU*" not in norm:
            assert (source == "dataset") == (found is not None), raw
        if source == "dataset":
            assert confidence == pytest.approx(round(min(0.99, max(0.7, found[1] / 100)), 2))
    assert any(s == "dataset" for ((_, s, _),) in sources.values())


def test_pinned_helpers():
    """Helpers that queries and their SQL share, by literal values."""
    assert T.normalised("Întreținere") != "" and T.normalised("chirie") == "chirie"
    assert T.terms_of("housing")[:1] == R.TRANSFER_TERMS["housing"]["exact_terms"][:1]
    assert {"INCASARE SALARIU", "SALARIU"} & set(R.salary_hints())
    assert set(R.SALARY_HINTS) <= set(R.salary_hints()) and not set(R.salary_hints()) & set(R.BROAD_HINTS) - set(R.SALARY_HINTS)
    assert len(R.TRANSACTION_COLUMNS) == 34 and R.FINAL_COLUMNS[:2] == ["Age", "Income_Category"] and R.FINAL_COLUMNS[-2:] == ["Risk_Score", "Behavior_Risk_Level"]
