"""Rules as tables: a user's dictionary of any size, rule files in a whole run, and memory carried from run to run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom import rules as R
from ledgerloom.operators import classify as C
from ledgerloom.operators import transfers as T
from ledgerloom.plans import end_to_end as E
from ledgerloom.sources import grammar as G
from ledgerloom.sources import sinks, tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_rows_of_a_dictionary_decide_as_its_conditions(spark):
    rows = T.counterparties(C.classify_types(tables.ledger(spark, DATA))).filter("txn_type = 'external_transfer'").withColumn("hay", F.trim(F.concat_ws(" ", "__recipient", "__text")))
    plain = {r.seq: r.m and tuple(r.m) for r in rows.select("seq", T.dictionary_match(F.col("hay")).alias("m")).collect()}
    joined = {r["seq"]: r["__exact"] and tuple(r["__exact"]) for r in T.dictionary_join(rows, "hay", T.dictionary_table(spark, R.TRANSFER_TERMS)).collect()}
    assert joined == plain and len(set(plain.values())) > 10


def external(k, text):
    return ("d", k, "external_transfer", text, "01/02/2027", None, 0.93)


ROWS = "doc_id string, seq long, txn_type string, raw_description string, booking_date string, category_area string, confidence double"


def test_a_dictionary_of_ten_thousand_terms(spark, tmp_path):
    terms = {"suppliers": {"exact_terms": [f"furnizor {k}x" for k in range(10_000)], "negative_terms": ["storno"], "fuzzy": None}, "housing": {"exact_terms": ["chirie"], "negative_terms": [], "fuzzy": None}}
    (tmp_path / "terms.json").write_text(json.dumps(terms))
    rules = E.Rules.from_files(terms=str(tmp_path / "terms.json"))
    rows = spark.createDataFrame([external(1, "IBAN; A; furnizor 77x"), external(2, "IBAN; B; furnizor 9999x storno chirie"), external(3, "IBAN; C; furnizor"), external(4, ";")], ROWS)
    out = {r.seq: (r.state, r.category_area, r.fuzzy_match_term) for r in T.classify_transfers(rows, fuzzy=False, terms=rules.terms).collect()}
    assert out == {1: ("confirmed", "Other", "furnizor 77x"), 2: ("confirmed", "Housing", "chirie"), 3: ("unknown", None, None), 4: ("unknown", None, None)}
    plan = lambda n: len(T.dictionary_join(T.counterparties(rows), "__text", spark.range(n).selectExpr("0 rank", "'c' category", "int(id) place", "'t' term", "string(id) norm", "false against"))._jdf.queryExecution().toString())
    assert plan(10_000) < 1.05 * plan(10)
    assert E.Rules.from_files(terms=str(tmp_path / "none.json")).terms is None


def page(lines):
    return "\n".join([*(f"antet {k}" for k in range(5)), "TRANZACTII EFECTUATE", *lines, *(f"subsol {k}" for k in range(5))])


PAGE = "doc_id string, page_no int, text string"


def test_rule_files_in_a_whole_run(spark, tmp_path):
    (tmp_path / "aliases.json").write_text('{"m": {"canonical": "Molid", "aliases": ["ATELIER MOLID"], "regex_aliases": ["^ZORI[0-9]"]}}')
    (tmp_path / "areas.json").write_text('{"merchant_categories": {"Molid": "Health"}, "regex_rules": [{"pattern": "molid", "category_area": "Food"}], "fallback_by_txn_type": {"card_purchase": "Entertainment"}}')
    (tmp_path / "terms.json").write_text('{"club": {"exact_terms": ["cotizatie"], "negative_terms": ["retur"], "fuzzy": 90}}')
    rules = E.Rules.from_files(*(str(tmp_path / f"{n}.json") for n in ("aliases", "areas", "terms")))
    text = page(["04/03/2027 POS ATELIER MOLID 12,50 RON", "05/03/2027 EPOS ZORI7 9,00 RON", "06/03/2027 PLATA INSTANT; Oana Dima; cotizatie 30,00", "07/03/2027 PLATA INSTANT; Mara Enache; chirie 40,00", "08/03/2027 PLATA INSTANT; Tudor Sava; cotizatiee 50,00"])
    out = {r.amount: r for r in E.run_statements(spark.createDataFrame([("d", 1, text)], PAGE), rules=rules).transactions.collect()}
    assert (out[12.5].merchant_canonical, out[12.5].category_area) == ("Molid", "Health")
    assert (out[9.0].mapping_method, out[9.0].category_area) == ("regex_rule", "Food") or out[9.0].merchant_canonical == "Molid"
    assert (out[30.0].state, out[30.0].category_area, out[30.0].fuzzy_match_term) == ("confirmed", "Other", "cotizatie")
    assert out[40.0].state == "unknown"  # the fixed dictionary does not count beside a user's


def test_memory_from_run_to_run(spark, tmp_path):
    path, iban = str(tmp_path / "memory"), G.ENTITIES[4]
    first = spark.createDataFrame([("a", 1, page([f"04/03/2027 PLATA INSTANT; Oana Dima; lease {iban} 30,00"]))], PAGE)
    later = spark.createDataFrame([("b", 1, page([f"04/04/2027 BENEFICIAR; Oana Dima {iban} 30,00", f"05/04/2027 TRANSFER EXTERN; Oana Dima; lease {iban} 31,00"]))], PAGE)
    states = lambda run: {r.amount: (r.state, r.match_source) for r in run.transactions.collect()}
    assert states(E.run_profile(first, path, "p")) == {30.0: ("confirmed", "bootstrap_exact")}
    assert set(states(E.run_profile(later, path, "p")).values()) == {("confirmed", "entity_memory")}
    kept = tables.load_memory(spark, path, "p", T.MEMORY).collect()
    assert [(r.entity_key, r.first_seen, r.last_seen, r.months_seen) for r in kept] == [(iban, "2027-03", "2027-04", 2)]
    E.run_profile(first, path, "q")
    assert {r.profile_id for r in spark.read.parquet(path).collect()} == {"p", "q"}


def test_a_table_of_pages_and_factor_text(spark, tmp_path):
    spark.createDataFrame([("d", 1, "x", 5)], f"{PAGE}, more int").write.parquet(str(tmp_path / "pages"))
    assert [tuple(r) for r in tables.read_pages(spark, str(tmp_path / "pages")).collect()] == [("d", 1, "x")]
    text = sinks.factor_text({"risk_score": 0.25, "saving_probability": 0.75, "risk_level": "healthy", "top_factors": [{"feature": "Age", "contribution": -0.5}]})
    assert text.splitlines()[:5] == ["Risk score: 0.250000", "Saving probability: 0.750000", "Risk level: healthy", "Top factors:", "  1. Age: -0.500000"] and text.count("  none") == 2
