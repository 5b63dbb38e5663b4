"""Small inline cases for single operators."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import rules as R
from ledgerloom import runtime
from ledgerloom.functions import similarity
from ledgerloom.operators import classify as C
from ledgerloom.operators import dedup as D
from ledgerloom.operators import expenses as E
from ledgerloom.operators import industry as J
from ledgerloom.operators import merchants as M
from ledgerloom.operators import scoring as S
from ledgerloom.operators import statements as P
from ledgerloom.operators import transfers as T
from ledgerloom.plans.end_to_end import run_statements
from ledgerloom.sources import grammar as G
from ledgerloom.sources import sinks, tables
from ledgerloom.sources.tables import month_key, read_registry, transactions

ROW = "transaction_id string, amount double, direction string, raw_description string, source_section string"
BOOKED, BLOCKED = "booked_transactions", "blocked_amounts"
IBAN = G.ENTITIES[8]


def test_column_lists():
    assert len(R.final_columns()) == len(set(R.final_columns())) == 64
    assert len(R.feature_columns()) == 19 and len(R.TRANSACTION_COLUMNS) == 34


def filled(form, j):
    """A form of the ledger's grammar after j rounds."""
    for slot, (words, every) in G.SLOTS.items():
        form = form.replace(f"{{{slot}}}", words[j // every % len(words)])
    return form.replace("{n}", str(j)).replace("{pair}", str(j // 2)).replace("{amount}", f"{j % 400},{j * 7 % 100:02d}")


#: The type that each form has as a booked debit; the salary form is a credit.
TYPE_OF_FORM = {"POS": "card_purchase", "EPOS": "card_purchase", "PLATA LA POS": "card_purchase", "{cash}": "cash_withdrawal", "{fee}": "bank_fee", "{internal}": "internal_transfer", "{external}": "external_transfer", "{salary}": "salary_income", "diverse": "unknown"}


def test_types(spark):
    rows, want = [], {}
    for f, form in enumerate(G.FORMS):
        kind = TYPE_OF_FORM[max((k for k in TYPE_OF_FORM if form.startswith(k)), key=len)]
        for j in (0, 1, 2):
            key = f"{f}-{j}"
            rows.append((key, 9.5, "credit" if kind == "salary_income" else "debit", filled(form, j), BOOKED))
            rows.append((key + "b", 9.5, "debit", filled(form, j), BLOCKED))
            want |= {key: kind, key + "b": "blocked_amount"}
    out = C.classify_types(spark.createDataFrame(rows, ROW))
    assert {r.transaction_id: r.txn_type for r in out.collect()} == want
    total, unknown = len(rows), sum(k == "unknown" for k in want.values())
    assert C.type_summary(out).first().valid_rate == round(1 - unknown / total, 4)


SHOP_FORMS = [f for f in G.FORMS if "{shop}" in f]


@pytest.mark.parametrize("form", SHOP_FORMS)
@pytest.mark.parametrize(
    "shop, merchant",
    [
        ("PRANZOBYESS@FBP C2", "PRANZOBYESS"),
        ("PAYU*ALTEX.RO", "PAYU*ALTEX.RO"),
        ("PPC ENERGIE SA", "PPC ENERGIE SA"),
        ("MEGAIMAGE 0290", "MEGAIMAGE"),
        ("AUCH", "AUCHAN ROMANIA SA"),
        ("METROREX VALIDATOARE", "METROREX VALIDATOARE"),
        ("LIBRARIA ZORI", "LIBRARIA ZORI"),
    ],
)
def test_merchants(spark, form, shop, merchant):
    text = filled(form.replace("{shop}", shop), 20)  # the town is one that names lose
    row = spark.createDataFrame([(text, "card_purchase")], "raw_description string, txn_type string")
    assert C.extract_merchants(row).first().merchant_raw == merchant


def test_no_merchant(spark):
    rows = spark.createDataFrame([("POS RO", "card_purchase"), ("POS CLUJ 12", "card_purchase"), (None, "card_purchase"), ("POS FROO", "bank_fee")], "raw_description string, txn_type string")
    assert {r.merchant_raw for r in C.extract_merchants(rows).collect()} == {None}


def test_normalised_names(spark):
    """Every alias by its own spelling, in small letters with marks, inside a longer text; a text no rule knows; none."""
    cases = [(spelling, name, "alias_exact") for name, spellings in R.ALIASES.items() for spelling in spellings]
    cases += [("f\u00e1rmac\u00eda", "Farmacia", "alias_exact"), ("la movieplex sala mica", "Movieplex", "alias_contains"), ("atelier molid", "atelier molid", "unmapped")]
    rows = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(cases)] + [(999, None)], "seq long, merchant_raw string").withColumn("confidence", F.lit(0.9))
    out = {r.seq: r for r in M.normalise_merchants(rows, M.alias_table(spark), fuzzy=False).collect()}
    for k, (text, name, method) in enumerate(cases):
        assert (out[k].merchant_canonical, out[k].merchant_match_method) == (name, method), text
    assert out[len(cases) - 1].confidence == 0.5 and (out[999].merchant_canonical, out[999].confidence) == (None, 0.9)


def test_registry_names_match_themselves(spark):
    names = ["MOLID COMERT SRL", "ZORI DISTRIBUTIE SA", "CARREFOUR DEPOZIT SA", "LIBRARIA NORD SRL"]
    firms = spark.createDataFrame(list(enumerate(names)), "firm_id long, name string")
    out = M.match_registry(firms.select("name"), firms, "name").collect()
    assert {(r.query, r.display, r.score) for r in out} == {(n, n, 100.0) for n in names}
    near = M.match_registry(spark.createDataFrame([("CARREFOUR ORADEA",)], "q string"), firms, "q").first()
    assert near.display == "CARREFOUR DEPOZIT SA"


def test_near_ties_go_by_foreign_tokens_in_order(spark):
    rows = [("q", 1, 80.0, 2, "B"), ("q", 2, 79.6, 1, "C"), ("q", 3, 79.8, 1, "A"), ("q", 4, 79.0, 0, "Z")]
    scored = spark.createDataFrame(rows, "query string, block_rank int, score double, foreign int, display string")
    assert M.registry_winners(scored).first().display == "A"


def test_ratios():
    assert similarity.token_set_ratio("mega image srl", "mega image") == 100.0
    assert similarity.token_set_ratio("", "x") == 0.0
    assert similarity.indel_ratio("abcd", "abcx") == 75.0
    assert similarity.sequence_ratio("abcd", "abcd") == 1.0


def lines(spark, rows):
    return spark.createDataFrame([("d", 1, k, t) for k, t in enumerate(rows)], "doc_id string, page_no int, line_no int, line string")


def parsed(spark, rows):
    return P.parse_candidates(P.candidates(lines(spark, rows))).orderBy("seq").collect()


def test_sections_and_signs(spark):
    out = parsed(spark, ["TRANZACTII EFECTUATE", f"11/01/2027 INCASARE {filled(G.SALARY, 3)} +812,40 RON", f"12/01/2027 {filled(G.FORMS[1], 5)} 64,15 RON", "SUME BLOCATE", "13/01/2027 POS 2,00"])
    assert [(r.amount, r.direction, r.source_section) for r in out] == [(812.4, "credit", BOOKED), (64.15, "debit", BOOKED), (2.0, "debit", BLOCKED)]


def test_noise_and_undated_entries(spark):
    out = parsed(spark, ["DATA DESCRIERE DEBIT CREDIT", "14/01/2027 POS MOLID 1,00", "14/01/2027 RULAJ ZI 9,00", "urmare", "Plata Instant; Oana Dima 2,00", "P2P BT PAY T7 3,00", "Taxa Serviciu SMS MAI 4,00"])
    assert [(r.booking_date, r.amount) for r in out] == [("14/01/2027", 1.0), ("14/01/2027", 2.0), ("14/01/2027", 4.0)]


def test_blocked_header_resets_the_date(spark):
    out = P.candidates(lines(spark, ["15/01/2027 MOLID 1,00", "SUME BLOCATE", "- 31.20 RON aferenta tranzactiei POS 16/01/2027 ZORI", "urmare"])).orderBy("candidate").collect()
    assert [(r.section, r.text) for r in out] == [(BOOKED, "15/01/2027 MOLID 1,00"), (BLOCKED, "- 31.20 RON aferenta tranzactiei POS 16/01/2027 ZORI urmare")]


@pytest.mark.parametrize("text, value", [("1,000.00", 1000.0), ("2.900,00", 2900.0), ("2,900", 2900.0), ("1.000.00", None), ("1,000,00", None), ("12,5", 12.5)])
def test_amounts(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(P.amount_value(F.col("t"))).first()[0] == value


def test_short_pages_lose_lines_in_both_ends(spark):
    pages = spark.createDataFrame([("d", 1, "a\nb\nc\nd\ne\nf")], "doc_id string, page_no int, text string")
    assert [r.line for r in P.without_headers(P.page_lines(pages)).orderBy("line_no").collect()] == ["a", "b", "e", "f"]
    assert P.without_headers(P.page_lines(pages), double_count=False).count() == 6


def test_transfers(spark):
    rows = [
        ("d", 1, "external_transfer", f"PLATA INSTANT; Tudor Sava; fara detalii {IBAN}"),
        ("d", 2, "external_transfer", f"PLATA INSTANT; Tudor Sava; lease {IBAN}"),
        ("d", 3, "external_transfer", f"TRANSFER EXTERN; Tudor Sava; cadou {IBAN}"),
        ("d", 4, "internal_transfer", "TRANSFER INTERN T1"),
        ("e", 1, "external_transfer", f"BENEFICIAR; Tudor Sava {IBAN}"),
        ("c", 9, "external_transfer", f"BENEFICIAR; Tudor Sava; imprumut {IBAN}"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, seq long, txn_type string, raw_description string").withColumns({"confidence": F.lit(0.93), "category_area": F.lit(None).cast("string"), "booking_date": F.lit("01/02/2026")})
    out = {(r.doc_id, r.seq): (r.state, r.match_source, r.category_area) for r in T.classify_transfers(df).collect()}
    assert out["d", 1] == ("confirmed", "entity_memory_backfill", "Housing")
    assert out["d", 2] == ("confirmed", "bootstrap_exact", "Housing")
    assert out["d", 3] == out["e", 1] == ("confirmed", "entity_memory", "Housing")
    assert out["d", 4][:2] == ("excluded", "internal_transfer_filter")
    assert out["c", 9] == ("unknown", "unknown", None)


def test_memory_rolls_forward(spark):
    memory = spark.createDataFrame([("k", "n", "Housing", 0.9, "confirmed", "2026-01", "2026-02", 2, "e")], T.MEMORY)
    seen = spark.createDataFrame([("k", "n", "Housing", 0.97, "confirmed", "e", "2026-03"), ("m", "o", "Other", 0.98, "confirmed", "e", "2026-03")], "entity_key string, canonical_name string, category string, confidence double, status string, evidence_type string, month string")
    out = {r.entity_key: (r.first_seen, r.last_seen, r.months_seen) for r in T.upsert_memory(memory, seen).collect()}
    assert out == {"k": ("2026-01", "2026-03", 3), "m": ("2026-03", "2026-03", 1)}


TOTALS = ["income_total", "outgoing_expense_total", "unknown_total", "electronics_gadgets_total", "essential_total", "nonessential_total", "outgoing_tx_count", "impulse_candidate_tx_count"]


def test_distribution_adds_up(spark):
    values = {**dict.fromkeys(E.TOTALS.values(), 0.0), **dict.fromkeys(TOTALS, 0.0)}
    values |= {f"impulse_{x}_{b}": 0.0 for x in ("spend", "tx_count") for b in R.IMPULSE_BUCKETS}
    values |= {"food_total": 1.0, "housing_total": 1.0, "other_total": 1.0, "income_total": 5.0, "outgoing_expense_total": 3.0}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    out = E.feature_vector(df).first().asDict()
    shares = [out[f"Expense_Distribution_{c}"] for c in R.DISTRIBUTION]
    assert sum(shares) == pytest.approx(100) and out["Expense_Distribution_Other"] == 33.3334 and out["Save_Money_Yes"] == 1
    empty = E.feature_vector(df.select(*[F.lit(0.0).alias(c) for c in df.columns])).first()
    assert set(empty) == {0}


def test_bands(spark):
    out = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.4, 0.7, 0.9)], "r double").select(E.frequency_band(F.col("r"))).collect()
    assert [r[0] for r in out] == [0, 1, 2, 3, 4]


def test_mirrored_transfer_keeps_the_credit_in_the_first_place(spark):
    rows = [(1, "1", 500.0, "debit"), (2, "2", 1.0, "debit"), (3, "3", 500.0, "credit"), (4, "4", 500.0, "credit")]
    df = spark.createDataFrame(rows, "seq long, transaction_id string, amount double, direction string").withColumns({"txn_type": F.lit("internal_transfer"), "raw_description": F.when(F.col("seq") == 2, "x").otherwise("REF: ABC123"), "booking_date": F.col("seq").cast("string"), "source_section": F.lit(BOOKED)})
    kept, removed = D.deduplicate(df)
    assert [(r.seq, r.transaction_id) for r in kept.orderBy("seq").collect()] == [(1, "3"), (2, "2")]
    assert {r.transaction_id for r in removed.collect()} == {"1", "4"}


def test_codes(spark):
    codes = {"5610": "Food", "3515": "Housing", "4932": "Transport", "5914": "Entertainment", "4773": "Health", "9602": "Personal_Care", "8559": "Child_Education", "": None}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.e for r in df.select("c", J.expense_category(F.col("c")).alias("e")).collect()} == codes


def test_company_lookup(spark):
    firms = spark.createDataFrame([(1, "MOLID COMERT SRL", "123")], "firm_id long, name string, cui string")
    external = spark.createDataFrame([("ALTA FIRMA", "Alta", "9", "1")], "query_norm string, name string, cui string, code string")
    out = {r.query: (r.source, r.cui) for r in J.resolve(spark.createDataFrame([("Molid",), ("Alta firma",), ("Nimic",)], "query string"), firms, external).collect()}
    assert out == {"Molid": ("onrc", "123"), "Alta firma": ("termene", "9"), "Nimic": ("not_found", None)}


def test_registry_file_with_mark_and_missing_file(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes("﻿ denumire^CUI\nA \"\"B\"\"^1\nC\n".encode())
    out = read_registry(spark, str(path), ["DENUMIRE", "CUI", "X"]).collect()
    assert [(r.CUI, r.X) for r in out] == [("1", None), (None, None)]
    assert read_registry(spark, str(tmp_path / "none.csv"), ["A"]).count() == 0


def test_month_keys(spark):
    dates = {"05/02/2026": "2026-02", "2026-03-01": "2026-03", "07-04-2026": "2026-04", "2026-13-99": "2026-13", "n/a": "unknown", None: "unknown"}
    out = spark.createDataFrame([(d,) for d in dates], "d string").select("d", month_key(F.col("d")).alias("m")).collect()
    assert {r.d: r.m for r in out} == dates


def test_scoring(spark):
    model = S.Model(["a", "b"], weights=[1.0, -2.0], intercept=0.0)
    rows = spark.createDataFrame([("r", 2.0, 0.5)], "k string, a double, b double")
    out = S.predict(rows, model, "k").first()
    assert out.saving_probability == pytest.approx(0.7310585786) and out.risk_level == "healthy"
    assert [f.feature for f in out.top_factors] == ["a", "b"] and [f.feature for f in out.healthy_factors] == ["b"]
    with pytest.raises(ValueError):
        S.predict(rows.drop("b"), model, "k")


def test_invalid_answers_are_errors(spark):
    df = spark.createDataFrame([("Nobody",)], "a string")
    with pytest.raises(Exception, match="invalid answer"):
        df.select(*S.one_hot(F.col("a"), "Gender", R.QUESTIONS["Gender"]).values()).collect()
    assert S.missing_features(["Gender_Female"]) == {"Gender": ["Gender_Male", "Gender_Prefer not to say"]}


def test_end_to_end_and_sinks(spark, tmp_path):
    text = "\n".join([f"antet {c}" for c in "abcde"] + ["TRANZACTII EFECTUATE", "04/03/2026 INCASARE PAYROLL MAI +905,00 RON", "05/03/2026 EPOS CARREFOUR MARKET 64,15 RON", "06/03/2026 POS TACO BELL KIOSK 18,00"] + [f"subsol {c}" for c in "abcde"])
    run = run_statements(spark.createDataFrame([("d1", 1, text)], "doc_id string, page_no int, text string"))
    rows = {r.merchant_canonical: r for r in run.transactions.collect()}
    assert rows["Carrefour"].category_area == "Food"
    final = run.final.filter("statement_month = '2026-03'").first()
    assert final.Income_Category == 905.0 and final.Save_Money_Yes == 1
    sinks.write_final(run.final, str(tmp_path / "final"))
    sinks.write_transactions(run.transactions.drop("seq"), str(tmp_path / "rows"))
    assert spark.read.csv(str(tmp_path / "final"), header=True).count() == run.final.count()
    assert transactions(run.transactions.drop("seq", "doc_id")).columns == [n for n, _ in R.TRANSACTION_COLUMNS]


def test_profiles(tmp_path):
    store = sinks.ProfileStore(str(tmp_path / "p.json"))
    a, b = store.create("A"), store.create("B")
    store.activate(b["profile_id"])
    store.delete(b["profile_id"])
    assert store.active()["profile_id"] == a["profile_id"]
    with pytest.raises(KeyError):
        store.update("none", name="x")


def test_streaming_totals(spark, tmp_path):
    from ledgerloom.streaming.ledger import windowed_totals

    rows = [("2026-01-01 10:00:00", 5.0, "debit", "POS CARREFOUR", BOOKED), ("2026-01-03 10:00:00", 7.0, "debit", "POS X", BOOKED)]
    schema = "ts timestamp, amount double, direction string, raw_description string, source_section string"
    spark.createDataFrame(rows, "ts string, amount double, direction string, raw_description string, source_section string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    q = windowed_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts").writeStream.format("memory").queryName("t").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.outgoing_expense_total for r in spark.table("t").collect()) == [5.0, 7.0]


def test_scalers_of_any_width(spark):
    columns = ["Age", "Income_Category", "Essential_Needs_Percentage", "x"]
    fit = lambda n, width: S.scaler_of(columns, [float(k) for k in range(n)], [2.0] * n, width)[0]
    assert fit(4, 4) == {"Age": 0.0, "Income_Category": 1.0, "Essential_Needs_Percentage": 2.0}
    assert fit(3, 3) == {"Age": 0.0, "Essential_Needs_Percentage": 1.0}  # all but the income
    assert fit(2, 2) == {"Essential_Needs_Percentage": 0.0}  # all but age and income
    wide = [*columns, "y", "z"]
    assert S.scaler_of(wide, [5.0, 6.0, 7.0], [1.0] * 3, 3)[0] == {"Age": 5.0, "Income_Category": 6.0, "Essential_Needs_Percentage": 7.0}
    assert S.scaler_of(wide, [5.0, 6.0], [1.0] * 2, 2)[0] == {"Age": 5.0, "Essential_Needs_Percentage": 6.0}
    assert S.scaler_of(wide, [5.0, 6.0, 7.0], [1.0] * 3)[0]["Income_Category"] == 6.0  # its width untold
    assert S.scaler_of(["x"], [1.0], [1.0], 1) == ({}, {})
    with pytest.raises(ValueError):
        S.scaler_of(wide, [1.0], [1.0], 1)


def test_strict_rows(spark):
    rows = spark.createDataFrame([("r", 1.0, None), ("s", 2.0, 3.0)], "k string, a double, b double")
    with pytest.raises(ValueError, match="extra"):
        S.strict_rows(rows, ["a"], "k")
    assert S.strict_rows(rows, ["a"], "k", projected=True).columns == ["k", "a"]
    with pytest.raises(Exception, match="non-finite"):
        S.strict_rows(rows, ["a", "b"], "k").collect()


def test_models_of_any_kind(spark):
    rows = spark.createDataFrame([("r", 0.5, 0.25)], "k string, a double, b double")
    score = S.predict(rows, S.Model(["a", "b"], weights=[1.0, 0.0], output="score"), "k").first()
    assert (score.risk_score, score.saving_probability) == (0.5, pytest.approx(0.377541, abs=1e-6))
    for function in (lambda x: (x[0], x[1]), lambda x: {"risk_score": x[0], "saving_probability": x[1]}):
        out = S.predict(rows, S.Model(["a", "b"], function=function), "k").first()
        assert (out.risk_score, out.saving_probability) == (0.5, 0.25)


def test_rule_files(spark, tmp_path):
    path = tmp_path / "aliases.yaml"
    path.write_text('{"b": {"canonical": "Beta", "aliases": ["BETA SHOP", " "], "regex_aliases": ["BET+A"]}, "a": {"canonical": "Alfa", "aliases": ["ALFA"]}, "c": {"aliases": ["NONE"]}}')
    aliases, patterns = tables.alias_rules(tables.read_rules(str(path)))
    assert list(aliases.items()) == [("Alfa", ["ALFA"]), ("Beta", ["BETA SHOP"])] and patterns == [("BET+A", "Beta", 0)]
    path.write_text('{"merchant_categories": {"Alfa": "Food", "": "x"}, "regex_rules": [{"pattern": "bet", "category_area": "Health"}, {"pattern": ""}], "fallback_by_txn_type": {"card_purchase": "Other"}}')
    rules = tables.category_rules(tables.read_rules(str(path)))
    rows = spark.createDataFrame([("Alfa",), ("Beta",), ("Gama",)], "merchant_canonical string").withColumn("txn_type", F.lit("card_purchase"))
    assert {r.merchant_canonical: r.category_area for r in C.map_categories(rows, rules).collect()} == {"Alfa": "Food", "Beta": "Health", "Gama": "Other"}


def test_memory_of_profiles(spark, tmp_path):
    row = lambda category, first: (IBAN, "x", category, 0.9, "confirmed", first, first, 1, "e")
    path = str(tmp_path / "memory")
    for profile, category in (("p", "Housing"), ("q", "Other")):
        sinks.save_memory(spark.createDataFrame([row(category, "2026-01")], T.MEMORY), path, profile)
    assert tables.load_memory(spark, path, "p", T.MEMORY).first().category == "Housing"
    assert tables.load_memory(spark, path, "z", T.MEMORY).count() == tables.load_memory(spark, path + "-none", "p", T.MEMORY).count() == 0
    rows = [(p, "d", k, "external_transfer", f"PLATA INSTANT; Tudor Sava; fara detalii {IBAN}") for k, p in enumerate("pq")]
    df = spark.createDataFrame(rows, "profile_id string, doc_id string, seq long, txn_type string, raw_description string")
    df = df.withColumns({"confidence": F.lit(0.5), "category_area": F.lit(None).cast("string"), "booking_date": F.lit("01/02/2026")})
    out = T.classify_transfers(df, spark.read.parquet(path), fuzzy=False)
    assert {r.profile_id: r.category_area for r in out.collect()} == {"p": "Housing", "q": "Other"}
    one = spark.createDataFrame([row("Other", "2026-02"), row("Housing", "2026-01")], T.MEMORY)
    assert {r.category_area for r in T.classify_transfers(df, one, fuzzy=False).collect()} == {"Housing"}  # the earliest counts


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k)) for k in range(7)], "seq long, amount double")
    assert '"transactions_omitted_from_report": 4' in sinks.run_report(rows, {"kpis": rows.limit(1)}, 3)
    sinks.write_report(rows, {"kpis": rows.filter("seq = 2")}, str(tmp_path / "r"), -1)
    assert spark.read.text(str(tmp_path / "r" / "transactions")).count() == 7
    assert spark.read.json(str(tmp_path / "r" / "sections")).first().kpis.amount == 2.0
    with pytest.raises(ValueError):
        sinks.run_report(rows, {}, -1)


def test_sweep(spark):
    kept = runtime.keep(spark.range(3).toDF("x"), "three")
    assert kept.count() == 3 and runtime.sweep(spark) and not runtime.sweep(spark)


def test_feature_needs():
    need = J.required_features(["Age", "Income_Category", "Save_Money_Yes"], ["Income_Category"])
    assert need == {"missing_program_features": ["Save_Money_Yes"], "required_profile_features": ["Age"]}


def test_income_of_a_prior_dataset(spark, tmp_path):
    rows = [("2026-01", "10"), ("2026-01", "12.5"), ("2026-02", "x"), (None, "3")]
    spark.createDataFrame(rows, "statement_month string, Income_Category string").coalesce(1).write.csv(str(tmp_path / "f"), header=True)
    out = tables.income_by_month(tables.read_final(spark, str(tmp_path / "f"))).collect()
    assert [(r.statement_month, r.Income_Category) for r in out] == [("2026-01", 12.5)]
