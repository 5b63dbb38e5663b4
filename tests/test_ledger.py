"""The stand-in ledger reaches every type, brand, alias, utility and dictionary rule; as do rows of memory."""

import os
import re

import pytest

from ledgerloom import rules as R
from ledgerloom.operators import classify as C
from ledgerloom.operators import merchants as M
from ledgerloom.operators import transfers as T
from ledgerloom.plans import queries as Q
from ledgerloom.sources.tables import ledger

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def rows(spark):
    return Q.typed(spark, DATA).collect()


def test_types_and_hints(rows):
    assert {r.txn_type for r in rows} == {"blocked_amount", "salary_income", "cash_withdrawal", "bank_fee", "internal_transfer", "external_transfer", "card_purchase", "unknown"}
    for hints in (R.ATM_HINTS, R.FEE_HINTS, R.INTERNAL_HINTS, R.EXTERNAL_HINTS, R.POS_HINTS, R.SALARY_HINTS):
        for hint in hints:
            assert any(hint in r.raw_description.upper() for r in rows), hint
    assert any(re.search(R.FEE_FRAGMENT, r.raw_description) and r.txn_type == "card_purchase" for r in rows)


def test_every_brand_names_a_merchant(rows):
    paid = [r for r in rows if r.txn_type == "card_purchase"]
    for pattern, name in [*R.FIRST_BRANDS, *R.BRANDS]:
        assert any(re.search(pattern, r.raw_description) and r.merchant_raw == name for r in paid), name
    assert any(r.merchant_raw and re.fullmatch(R.PAYMENT_GATEWAY, r.merchant_raw) for r in paid)
    assert any(re.search(r"MEGAIMAGE \d", r.raw_description) and r.merchant_raw == "MEGAIMAGE" for r in paid)
    assert any(r.merchant_raw is None for r in paid) and any(r.merchant_raw == "ATELIER MOLID" for r in paid)


def test_every_alias_and_utility_rule(spark, rows):
    found = {r.merchant_canonical for r in M.normalise_merchants(Q.typed(spark, DATA), M.alias_table(spark), fuzzy=False).select("merchant_canonical").distinct().collect()}
    assert set(R.ALIASES) - found == set()
    for term in R.UTILITY_TERMS:
        assert any(term in (n or "").lower() for n in found), term
    assert {R.MERCHANT_CATEGORIES[n] for n in found if n in R.MERCHANT_CATEGORIES} == set(R.MERCHANT_CATEGORIES.values())


def test_every_dictionary_rule(spark):
    df = T.counterparties(C.classify_types(ledger(spark, DATA))).filter("txn_type = 'external_transfer'")
    match = T.dictionary_match(Q.F.trim(Q.F.concat_ws(" ", "__recipient", "__text")))
    out = df.select("raw_description", match["category"].alias("category"), match["term"].alias("term")).collect()
    assert {r.category for r in out} == {*R.TRANSFER_TERMS, None}
    assert all(any(n in r.raw_description and r.category != "housing" for r in out) for n in R.TRANSFER_TERMS["housing"]["negative_terms"])


def test_memory_goes_both_ways(spark):
    found = {r.match_source for r in Q.q_memory_backfill(spark, DATA).collect()}
    assert {"entity_memory", "entity_memory_backfill", "bootstrap_exact", "unknown", "internal_transfer_filter"} <= found
