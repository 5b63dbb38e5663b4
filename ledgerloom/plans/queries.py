"""One query for each operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from ..operators import classify as C
from ..operators import dedup as D
from ..operators import expenses as E
from ..operators import industry as J
from ..operators import merchants as M
from ..operators import scoring as S
from ..operators import statements as P
from ..operators import transfers as T
from ..operators.asof import last_evidence
from ..runtime import keep, scratch
from ..sources import grammar as G
from ..sources import sinks
from ..sources.parsed import page_keys, parse_new, parsed
from ..sources.tables import ledger, month_key, read_table, renamed_fields, traceability
from ..streaming import duplicates as SD
from ..streaming import memory as SM
from .end_to_end import classify_rows, score_months

#: Amounts as statements write them.
LITERALS = ["1,000.00", "2.900,00", "2,900", "1.000.00", "1,000,00", "12,5", "77.20", "+3500,00", "-12.30", "1234", "12,34"]
PATTERNS = [("^LIBRARIA\\b", "Libraria", 1), ("CAFENEA|ZORI", "Cafenea", 2), ("MOLID", "Molid", 3)]
EXTERNAL = [("ATELIER MOLID", "Atelier Molid", "123", "4711"), ("COLD", "Cold Stores", "77", "5610")]
MEMORY = [(G.ENTITIES[3], "Mara Enache", "Housing", 0.97, "confirmed", "2023-12", "2024-01", 2, "exact_text")]
#: Rows of the payee that gives no reason, but for these.
LATE = f"seq % {7 * len(G.FORMS)} = {6 * len(G.FORMS) + G.FORMS.index(G.SILENT)} AND txn_type = 'external_transfer'"
#: Weights of the linear model over embeddings, by a rule.
WEIGHTS = [((k * 37) % 21 - 10) / 10 for k in range(64)]


def classified(spark: SparkSession, d: str) -> DataFrame:
    return E.with_month(classify_rows(ledger(spark, d), fuzzy=False))


def typed(spark: SparkSession, d: str) -> DataFrame:
    return C.extract_merchants(C.classify_types(ledger(spark, d)))


def typed_once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Columns of typed rows, written out: conditions on merchants, and a second reader, do not compute the cascades anew."""
    return keep(typed(spark, d).select(*columns), "typed")


def norms(spark: SparkSession, d: str) -> DataFrame:
    own = typed_once(spark, d, "merchant_raw")
    return keep(M.spellings(own.union(read_table(spark, d, "part").select("p_name"))).select("norm").distinct(), "norms")


def q_ledger_adapter(spark, d):
    return ledger(spark, d)


def q_month_key(spark, d):
    return ledger(spark, d).select("seq", "booking_date", month_key(F.col("booking_date")).alias("statement_month"))


def q_txn_type_cascade(spark, d):
    return C.classify_types(ledger(spark, d)).select("seq", "channel", "txn_type", "confidence")


def q_txn_type_summary(spark, d):
    return C.type_summary(C.classify_types(ledger(spark, d)), "doc_id")


def q_merchant_extract(spark, d):
    return typed(spark, d).select("seq", "merchant_raw")


def q_alias_exact_join(spark, d):
    return M.exact_alias(norms(spark, d), M.alias_table(spark))


def q_alias_contains_join(spark, d):
    return M.contained_alias(norms(spark, d), M.alias_table(spark))


def q_alias_regex_join(spark, d):
    return M.pattern_alias(norms(spark, d), spark.createDataFrame(PATTERNS, "pattern string, name string, priority int"))


def q_normalise_cascade(spark, d):
    patterns = spark.createDataFrame(PATTERNS[:2], "pattern string, name string, priority int")
    external = spark.createDataFrame(EXTERNAL, "query_norm string, name string, cui string, code string")
    out = M.normalise_merchants(typed_once(spark, d, "seq", "raw_description", "merchant_raw", "confidence"), M.alias_table(spark), patterns=patterns, external=external, fuzzy=False)
    return out.select("seq", "merchant_canonical", "normalization_source", "merchant_match_method", "mapping_method", "confidence")


def registry_of_merchants(spark: SparkSession, d: str) -> DataFrame:
    """A registry of firms: parts, and the merchants' own spellings with a legal form."""
    parts = firms(spark, d).select("firm_id", "name")
    own = typed_once(spark, d, "seq", "merchant_raw").filter("merchant_raw is not null and merchant_raw != '' and seq % 2 = 0").groupBy("merchant_raw").agg(F.min("seq").alias("firm_id"))
    return parts.unionByName(own.select((F.col("firm_id") + 1_000_000_000).alias("firm_id"), F.concat("merchant_raw", F.lit(" SRL")).alias("name")))


def q_normalise_registry(spark, d):
    """Names by registry first: the whole cascade with firms."""
    out = M.normalise_merchants(typed_once(spark, d, "seq", "raw_description", "merchant_raw", "confidence"), M.alias_table(spark), keep(registry_of_merchants(spark, d), "firms"), fuzzy=False)
    return out.select("seq", "merchant_canonical", "normalization_source", "merchant_match_method", "mapping_method", "confidence")


def q_registry_exact(spark, d):
    """Names that a firm has, or whose tokens it has, with the brand that the firm's name gives."""
    found = M.exact_registry(M.registry_queries(norms(spark, d), "norm"), M.registry(registry_of_merchants(spark, d))).withColumn("score", F.lit(100.0))
    return M.brand_names(keep(found, "exact-firms"), M.alias_table(spark)).select("query", "brand")


def q_category_map(spark, d):
    rows = M.normalise_merchants(typed_once(spark, d, "seq", "raw_description", "txn_type", "merchant_raw", "confidence"), M.alias_table(spark), fuzzy=False)
    return C.map_categories(rows).select("seq", "merchant_canonical", "category_area", "mapping_method")


def q_category_summary(spark, d):
    rows = classified(spark, d)
    return C.category_summary(rows, "doc_id").join(C.classification_summary(rows, "doc_id"), "doc_id")


def q_row_flags(spark, d):
    names = ["final_spend_category", "is_essential", "is_nonessential", "is_internal_transfer", "is_salary", "is_housing", "is_utility", "is_impulse_candidate", "impulse_category"]
    return classified(spark, d).select("seq", *names)


def q_expense_totals(spark, d):
    return E.expense_totals(classified(spark, d), "doc_id", "statement_month")


def q_expense_totals_with_fees(spark, d):
    return E.expense_totals(classified(spark, d), "doc_id", "statement_month", include_bank_fees=True)


def q_expense_totals_rollup(spark, d):
    return E.expense_totals_with_overall(classified(spark, d), "doc_id", "statement_month")


def q_distribution_percent(spark, d):
    return E.distribution_percent(q_expense_totals(spark, d), "doc_id", "statement_month")


def q_feature_vector_month(spark, d):
    return E.feature_vector(q_expense_totals(spark, d), "doc_id", "statement_month")


def q_impulse_winner(spark, d):
    return q_expense_totals(spark, d).select("doc_id", "statement_month", *[c.alias(n) for n, c in E.impulse_flags().items()])


def q_final_row_month(spark, d):
    rows = classified(spark, d)
    features = E.feature_vector(E.expense_totals(rows, "doc_id", "statement_month"), "doc_id", "statement_month")
    income = E.salary_metrics(rows, "doc_id", "statement_month").select("doc_id", "statement_month", F.col("salary_income_total").alias("__income"))
    profile = read_table(spark, d, "labels").select("doc_id", F.col("quality").alias("Gender_Female"))
    joined = features.join(income, ["doc_id", "statement_month"]).join(profile, "doc_id", "left")
    return E.final_row(joined, "doc_id", "statement_month", income="__income", profile=["Gender_Female"])


def q_salary_metrics(spark, d):
    return E.salary_metrics(classified(spark, d), "doc_id")


def q_transfer_metrics(spark, d):
    return E.transfer_metrics(classified(spark, d), "doc_id")


def q_kpi_block(spark, d):
    return E.kpi_block(classified(spark, d), "doc_id")


def q_quality_metrics(spark, d):
    return E.quality_metrics(classified(spark, d), "doc_id")


def q_label_accuracy(spark, d):
    rows = read_table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("seq"), (F.col("n_chars") > 200).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return E.label_accuracy(rows, read_table(spark, d, "labels"), "doc_id", ["quality", "toxic"])


def q_summary_merge(spark, d):
    rows = classified(spark, d)
    parts = C.type_summary(rows, "doc_id", "channel").join(C.category_summary(rows, "doc_id", "channel").select("doc_id", "channel", "unknown_category"), ["doc_id", "channel"])
    return C.merged_summaries(parts, "doc_id")


def q_profile_hash(spark, d):
    return E.profile_hash(ledger(spark, d), "doc_id")


def q_dedup_exact(spark, d):
    rows = ledger(spark, d)
    kept, _ = D.without_repeats(rows.unionByName(rows.withColumn("seq", F.col("seq") + 1_000_000_000)))
    return kept.select("seq", "transaction_id", "booking_date", "amount")


def with_mirrors(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Classified rows, and of every third transfer the other account's side: the other direction, a later row."""
    rows = C.classify_types(ledger(spark, d, *more))
    other = rows.filter("txn_type in ('internal_transfer', 'external_transfer') and seq % 3 = 0")
    other = other.withColumns({"direction": F.when(F.col("direction") == "debit", "credit").otherwise("debit"), "seq": F.col("seq") + 1_000_000_000, "transaction_id": F.concat("transaction_id", F.lit("m"))})
    return rows.unionByName(other)


def q_dedup_mirror(spark, d):
    kept, _ = D.without_mirrors(with_mirrors(spark, d))
    return kept.select("seq", "transaction_id", "direction", "txn_type")


def q_removed_ids(spark, d):
    return D.deduplicate(with_mirrors(spark, d))[1].select("transaction_id", "seq", "reason")


def documents_as_pages(spark, d):
    return read_table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text")


def q_split_lines(spark, d):
    return P.page_lines(documents_as_pages(spark, d)).select("page_no", "line_no", "line")


def q_line_keys(spark, d):
    rows = P.page_lines(documents_as_pages(spark, d))
    return rows.groupBy(X.masked(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(P.is_noise()).alias("noise"))


def q_header_footer_removal(spark, d):
    return P.without_headers(P.page_lines(documents_as_pages(spark, d))).select("doc_id", "page_no", "line_no", "line")


def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of made-up statements, one document for each user: headers, dated and undated entries, noise, more text."""
    rows = ledger(spark, d)
    e, date = F.col("seq"), F.when(F.col("booking_date").rlike(R.DATE_START), F.col("booking_date")).otherwise("09/09/2024")
    body = F.concat(F.col("raw_description"), F.lit(" "), F.format_string("%.2f", F.col("amount")))
    line = (
        F.when(e % 97 == 0, "SUME BLOCATE")
        .when(e % 89 == 0, "TRANZACTII EFECTUATE")
        .when(e % 53 == 0, F.concat(date, F.lit(" RULAJ ZI 1,00")))
        .when(e % 13 == 0, F.concat(F.lit("- "), body, F.lit(" aferenta tranzactiei "), date))
        .when(e % 5 == 0, body)
        .otherwise(F.concat_ws(" ", date, body))
    )
    first = rows.select("doc_id", F.lit(1).alias("page_no"), (2 * e).alias("line_no"), line.alias("line"))
    second = rows.filter(e % 3 == 0).select("doc_id", F.lit(1).alias("page_no"), (2 * e + 1).alias("line_no"), F.concat(F.lit("continuare "), F.col("seq").cast("string"), F.when(e % 6 == 0, " CREDIT 12,50").otherwise("")).alias("line"))
    return first.unionByName(second)


def q_statement_candidates(spark, d):
    return P.candidates(statement_lines(spark, d))


def q_statement_parse(spark, d):
    return P.parse_candidates(P.candidates(statement_lines(spark, d)))


def statement_pages(spark: SparkSession, d: str) -> DataFrame:
    """The made-up statements as one page each."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return statement_lines(spark, d).groupBy("doc_id").agg(F.lit(1).alias("page_no"), F.array_join(lines, "\n").alias("text"))


def q_parse_incremental(spark, d):
    """Every other statement is parsed first, then all are given again: the second run parses the others only."""
    pages, store = keep(statement_pages(spark, d), "statement-pages"), scratch(spark, "parsed")
    keys = keep(page_keys(pages), "page-keys")
    parse_new(pages.filter("doc_id % 2 = 0"), store, keys.filter("doc_id % 2 = 0"))
    parse_new(pages, store, keys)
    return parsed(spark, store, keys)


def q_amount_parse(spark, d):
    """Amounts as statements may write them: fixed literals, and prices of parts in four notations."""
    price, key = F.col("p_retailprice"), F.col("p_partkey")
    plain = F.format_string("%.2f", price)
    notation = F.when(key % 4 == 0, plain).when(key % 4 == 1, F.replace(plain, F.lit("."), F.lit(","))).when(key % 4 == 2, F.format_number(price, 2)).otherwise(F.concat(F.lit("-"), F.translate(F.format_number(price, 2), ",.", ".,")))
    literals = spark.createDataFrame([(x,) for x in LITERALS], "literal string").union(read_table(spark, d, "part").select(notation)).distinct()
    return literals.select("literal", P.amount_value(F.ltrim(F.col("literal"), F.lit("+-"))).alias("amount"))


def q_transaction_id(spark, d):
    rows = ledger(spark, d).withColumn("raw_description", P.description(F.concat_ws(" ", "booking_date", "raw_description"), F.col("booking_date")))
    return rows.select("seq", "raw_description", P.transaction_id(F.col("seq"), F.col("booking_date"), F.col("amount"), F.col("direction"), F.col("raw_description"), F.col("source_section")).alias("id"))


def firms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part names as a registry."""
    return read_table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("firm_id")).select("firm_id", F.col("p_name").alias("name"), F.col("firm_id").cast("string").alias("cui"))


def wanted(spark: SparkSession, d: str) -> DataFrame:
    """Queries: brand and type of parts with the last word of their name, so that some fit and some do not."""
    part = read_table(spark, d, "part")
    return part.select(F.concat_ws(" ", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.element_at(F.split("p_name", " "), -1), F.lit(" stores"))).otherwise(F.lower("p_type"))).alias("query")).distinct()


def q_registry_tokens(spark, d):
    names = read_table(spark, d, "supplier").select(F.col("s_name").alias("name")).union(read_table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lit("SRL Romania"), "p_type"))).distinct()
    norm = X.registry_name(F.col("name"))
    return names.select("name", F.array_join(F.array_sort(X.name_tokens(norm, True)), "|").alias("screened"), F.array_join(F.array_sort(X.name_tokens(norm, False)), "|").alias("tokens"), F.array_join(M.important_tokens(X.name_tokens(norm, True)), "|").alias("important"))


def q_registry_blocking(spark, d):
    queries, reg = M.registry_queries(wanted(spark, d), "query"), M.registry(firms(spark, d))
    return M.blocking_scores(queries, reg)


def q_registry_topk_match(spark, d):
    return J.best_firm(wanted(spark, d), firms(spark, d)).select("query", "firm_id", F.bround("score", 6).alias("score"))


def q_registry_code_join(spark, d):
    own = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("firm"))
    codes = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("firm"), F.col("l_partkey").cast("string").alias("code"))
    names = read_table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 4, "0").alias("class"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    return J.firm_codes(own, codes, names, "firm")


def q_registry_resolve(spark, d):
    external = spark.createDataFrame([("COLD STORES", "Cold Stores", "77", "5610"), ("ECONOMY", "Economy Trade", "78", "4711")], "query_norm string, name string, cui string, code string")
    return J.resolve(wanted(spark, d), firms(spark, d), external)


def q_primary_code_category(spark, d):
    codes = read_table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") * 7 + 1000).alias("code"))
    return J.primary_category(codes, "l_suppkey", "code")


def q_code_tables(spark, d):
    code = (F.col("l_partkey") * 7 + 1000).cast("string")
    codes = read_table(spark, d, "lineitem").select(code.alias("code")).distinct()
    c = F.col("code")
    return codes.select("code", J.industry_code(c).alias("normalised"), J.expense_category(c).alias("category"), J.impulse_category(c).alias("impulse"), J.lifetime_bucket(c).alias("lifetime"))


def q_transfer_exact_terms(spark, d):
    rows = T.counterparties(C.classify_types(ledger(spark, d))).filter(F.col("txn_type").isin(T.TRANSFER_TYPES))
    match = T.dictionary_match(F.trim(F.concat_ws(" ", "__recipient", "__text")))
    return rows.select("seq", "recipient_iban", "recipient_name", "entity_key", match["category"].alias("category"), match["term"].alias("term"))


def with_memory(spark: SparkSession, d: str) -> DataFrame:
    rows = C.classify_types(ledger(spark, d)).withColumn("category_area", F.lit(None).cast("string"))
    # One payee gives its reason late, so that earlier rows are filled back.
    late = F.when(F.expr(LATE), F.concat(F.col("raw_description"), F.lit("; chirie"))).otherwise(F.col("raw_description"))
    return rows.withColumns({"raw_description": late})


def q_memory_backfill(spark, d):
    out = T.classify_transfers(with_memory(spark, d), spark.createDataFrame(MEMORY, T.MEMORY), fuzzy=False)
    return out.filter(F.col("txn_type").isin(T.TRANSFER_TYPES)).select("seq", "state", "evidence_type", "match_source", "category_area", "confidence", "fuzzy_match_term", "fuzzy_match_score")


def q_memory_upsert(spark, d):
    # Types and evidence are written out: conditions on them would be pushed down and compute them anew, several times for each row.
    rows = with_memory(spark, d).select("doc_id", "seq", "booking_date", "raw_description", "txn_type", "confidence", "category_area")
    active = keep(rows, "typed").filter(F.col("txn_type").isin("external_transfer", "salary_income"))
    own = T.own_evidence(T.counterparties(active), fuzzy=False).select("doc_id", "seq", "booking_date", "txn_type", "recipient_name", "entity_key", "__own")
    learned = T.remember_first(keep(own, "evidence")).withColumn("month", F.col("last_seen")).select("entity_key", "canonical_name", "category", "confidence", "status", "evidence_type", "month")
    return T.upsert_memory(spark.createDataFrame(MEMORY, T.MEMORY), learned)


def q_fuzzy_alias(spark, d):
    return M.fuzzy_alias(norms(spark, d), M.alias_table(spark), 0.6)


def q_fuzzy_terms(spark, d):
    rows = T.counterparties(C.classify_types(ledger(spark, d))).filter("txn_type = 'external_transfer'")
    return T.fuzzy_terms(rows.select(F.col("__text").alias("text")), "text")


def q_registry_fuzzy(spark, d):
    return M.match_registry(wanted(spark, d), firms(spark, d), "query")


def q_onehot_encode(spark, d):
    segments = {s: f"Segment_{s.title()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    steps = {"1-URGENT": 4.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0, "4-NOT SPECIFIED": 1.0, "5-LOW": 0.0}
    orders = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "; ").alias("statuses"), F.max("o_orderpriority").alias("priority"))
    rows = read_table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    status = S.multi_hot(F.col("statuses"), "status", {"F": "Status_F", "O": "Status_O", "P": "Status_P"})
    return rows.select("c_custkey", *[c.alias(n) for n, c in {**S.one_hot(F.col("c_mktsegment"), "segment", segments), **status}.items()], S.ordinal(F.col("priority"), "priority", steps).alias("Priority"))


def q_onehot_decode(spark, d):
    segments = {s: f"Segment_{s.title()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    steps = {"1-URGENT": 4.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0, "4-NOT SPECIFIED": 1.0, "5-LOW": 0.0}
    rows = q_onehot_encode(spark, d)
    many = S.decode_many({"F": "Status_F", "O": "Status_O", "P": "Status_P"})
    return rows.select("c_custkey", S.decode_choice(segments).alias("segment"), F.array_join(many, "; ").alias("statuses"), S.decode_ordinal("Priority", steps).alias("priority"))


def profile_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of customers, by rule, as a questionnaire gives them."""
    key = F.col("c_custkey")
    pick = lambda labels, by: F.element_at(F.array(*map(F.lit, labels)), (by % len(labels) + 1).cast("int"))
    columns = [pick(list(o), key + k).alias(g) for k, (g, o) in enumerate(R.QUESTIONS.items())]
    columns += [F.concat_ws("; ", pick(list(o), key), F.when(key % 2 == 0, pick(list(o), key + 1))).alias(g) for g, o in R.MULTI_QUESTIONS.items()]
    columns += [pick(list(s), key + k).alias(g) for k, (g, (_, s)) in enumerate(R.ORDINAL_QUESTIONS.items())]
    columns += [F.when((key % 5 == 0) & F.lit(n in R.LIFETIMES), "not purchased yet").otherwise((20 + (key + k) % 40).cast("string")).alias(n) for k, n in enumerate(R.NUMERIC_FEATURES)]
    return read_table(spark, d, "customer").select("c_custkey", *columns)


def q_profile_encode(spark, d):
    encoded = S.encode_profiles(profile_answers(spark, d), "c_custkey")
    return encoded.select("c_custkey", *[c for c in encoded.columns if c != "c_custkey"], S.complete(encoded.columns).alias("complete"))


def q_assemble_row(spark, d):
    features = E.feature_vector(E.expense_totals(classified(spark, d), "doc_id"), "doc_id").withColumn("Income_Category", F.lit(1000.0)).withColumnRenamed("doc_id", "c_custkey")
    profile = S.encode_profiles(profile_answers(spark, d), "c_custkey")
    columns = [c for c in R.final_columns() if c not in ("Risk_Score", "Behavior_Risk_Level")]
    return S.assemble(features, profile, "c_custkey", columns)


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x, i: F.when(i < 8, (x.cast("double") - 0.01) / 0.1).otherwise(x.cast("double"))).alias("x"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    saving = S.sigmoid(S.dot(F.col("x"), WEIGHTS) + 0.25)
    risk = S.clamp(F.bround(1 - saving, 6))
    return model_rows(spark, d).withColumns({"risk_score": risk, "saving_probability": F.bround(S.clamp(saving), 6)})


#: Names of a vector's numbers as a model's columns: the scaled ones first.
VECTOR = [*R.SCALED_FEATURES, *(f"f{k:02d}" for k in range(len(R.SCALED_FEATURES), 64))]


def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(VECTOR)])


def vector_model(width: int | None = None, size: int = 64) -> S.Model:
    """A linear model over VECTOR, its scaler given by place for ``size`` columns."""
    mean, scale = S.scaler_of(VECTOR, [0.01] * size, [0.1] * size, width)
    return S.Model(VECTOR, mean, scale, WEIGHTS, 0.25)


def q_scale_score(spark, d):
    out = S.predict(vector_rows(spark, d), vector_model(), "vec_id")
    return out.select("vec_id", "risk_score", F.bround("saving_probability", 6).alias("saving_probability"), "risk_level")


def q_scaler_widths(spark, d):
    """The same rows by the six kinds of scalers: on all columns, without income, without age and income, on the scaled ones, on
    these without income, and one that does not tell its width."""
    n = len(R.SCALED_FEATURES)
    kinds = {"full": (64, 64), "no_income": (63, 63), "no_age_income": (62, 62), "subset": (n, n), "subset_no_income": (n - 1, n - 1), "untold": (None, n)}
    out = None
    for name, (width, size) in kinds.items():
        part = S.predict(vector_rows(spark, d), vector_model(width, size), "vec_id").select(F.lit(name).alias("scaler"), "vec_id", "risk_score")
        out = part if out is None else out.unionByName(part)
    return out


#: Weights of a linear model over the final columns, by a rule.
MONTH_COLUMNS = [c for c in R.final_columns() if c not in ("Risk_Score", "Behavior_Risk_Level")]
MONTH_WEIGHTS = [((k * 29) % 17 - 8) / 400 for k in range(len(MONTH_COLUMNS))]


def q_score_months(spark, d):
    """Predictions of the final monthly rows; a feature without a value counts as 0."""
    model = S.Model(MONTH_COLUMNS, {"Essential_Needs_Percentage": 50.0, "Income_Category": 1000.0}, {"Essential_Needs_Percentage": 20.0, "Income_Category": 2000.0}, MONTH_WEIGHTS, 0.1)
    out = score_months(q_final_row_month(spark, d), model, ("doc_id", "statement_month"))
    return out.select("doc_id", "statement_month", F.bround("risk_score", 4).alias("risk_score"), F.bround("saving_probability", 4).alias("saving_probability"))


def q_field_renames(spark, d):
    """Shares under older names, some no numbers, some given twice."""
    key = F.col("c_custkey")
    rows = read_table(spark, d, "customer").select(
        "c_custkey",
        F.when(key % 5 == 0, "n/a").otherwise((key % 100).cast("string")).alias("Expense_Distribution_Food"),
        F.when(key % 3 == 0, F.lit(None).cast("string")).otherwise((key % 50).cast("string")).alias("food_total_pct"),
        F.when(key % 7 == 0, "x").otherwise(F.col("c_acctbal").cast("int").cast("string")).alias("housing_total_pct"),
        (key % 9).alias("Save_Money_Yes"),
    )
    return renamed_fields(rows, "c_custkey")


def q_traceability(spark, d):
    return traceability(documents_as_pages(spark, d))


def q_factor_topk(spark, d):
    names = F.array(*[F.lit(f"f{k:02d}") for k in range(64)])
    made = S.factors(F.col("x"), names, WEIGHTS)
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["feature"], F.format_string("%.6f", x["contribution"]))), ",")
    return model_rows(spark, d).select("vec_id", *[flat(c).alias(n) for n, c in made.items()])


RULES = [{"metric": "risk_score", "operator": ">=", "value": 0.9, "message": "very_high"}, {"metric": "saving_probability", "operator": "<", "value": 0.2}, {"metric": "risk_score", "operator": "<=", "value": 0.1, "message": "safe"}]


def q_alerts(spark, d):
    return scored(spark, d).select("vec_id", F.array_join(S.alerts(F.col("risk_score"), F.col("saving_probability"), RULES), ",").alias("alerts"))


def q_monthly_average(spark, d):
    names = F.array(*[F.lit(f"f{k:02d}") for k in range(64)])
    rows = scored(spark, d).withColumn("top_factors", S.factors(F.col("x"), names, WEIGHTS)["top_factors"])
    out = S.average_predictions(rows, "label")
    return out.select("label", "risk_score", "saving_probability", "months", F.array_join(F.transform("factors", lambda x: x["feature"]), ",").alias("factors"))


#: Layers of the dense model: name, outputs, inputs, and its numbers by a rule of places i (output) and j (input).
NET = [("shared_trunk.0", 8, 64, "((i * 7 + j * 3) % 11 - 5) / 20"), ("shared_trunk.3", 4, 8, "((i * 5 + j * 2) % 7 - 3) / 4"), ("risk_head", 1, 4, "(j % 3 - 1) / 2"), ("savings_head", 1, 4, "(1 - j % 2) / 3")]
BIAS = "(i % 3 - 1) / 10"


def net_weights(spark: SparkSession) -> DataFrame:
    """Named weights as a checkpoint has them."""
    out = None
    for name, wide, deep, rule in NET:
        cells = spark.range(wide * deep).select(F.floor(F.col("id") / deep).alias("i"), (F.col("id") % deep).alias("j"))
        cells = cells.select(F.struct("i", "j", F.expr(f"double({rule})").alias("v")).alias("c"))
        one = cells.agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]).alias("values"))
        own = one.select(F.lit(f"{name}.weight").alias("name"), F.array(F.lit(wide), F.lit(deep)).alias("shape"), "values")
        bias = spark.range(wide).toDF("i").select(F.struct("i", F.expr(f"double({BIAS})").alias("v")).alias("c"))
        bias = bias.agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]).alias("values")).select(F.lit(f"{name}.bias").alias("name"), F.array(F.lit(wide)).alias("shape"), "values")
        both = own.unionByName(bias)
        out = both if out is None else out.unionByName(both)
    return out


def q_dense_scores(spark, d):
    """Scores of a net that is read from a table of named weights."""
    model = S.net_from_weights(net_weights(spark))
    return model_rows(spark, d).withColumn("s", S.dense_scores_udf(model)("x")).select("vec_id", F.bround("s.risk", 6).alias("risk_score"), F.bround("s.saving", 6).alias("saving_probability"))


def q_month_backfill_update(spark, d):
    features = E.feature_vector(E.expense_totals(classified(spark, d), "statement_month"), "statement_month")
    final = E.final_row(features, "statement_month")
    inferred = spark.createDataFrame([("2024-01", 0.15), ("2024-02", 0.5)], "statement_month string, risk_score double")
    fallback = spark.createDataFrame([(-0.25,)], "risk_score double")
    return S.fill_back(final, inferred, fallback).select("statement_month", "Risk_Score", "Behavior_Risk_Level", "Save_Money_Yes")


def q_report_cap(spark, d):
    """The transactions of a report, which takes the first 500, with the number left out."""
    rows, omitted = sinks.capped(ledger(spark, d), 500)
    return rows.select("seq", "transaction_id", "amount").join(F.broadcast(omitted), F.lit(True))  # one row


def q_semi_anti_union_sets(spark, d):
    orders, customers = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    big = orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    parts = {
        "semi": customers.join(big, "c_custkey", "left_semi").select("c_custkey"),
        "anti": customers.join(big, "c_custkey", "left_anti").select("c_custkey"),
        "intersect": big.intersect(urgent),
        "except": big.exceptAll(urgent).distinct(),
        "union": big.union(urgent).distinct(),
    }
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("part"), "c_custkey")
        out = one if out is None else out.unionByName(one)
    return out


def arriving(rows: DataFrame, name: str, column: str, parts: int = 3) -> DataFrame:
    """rows as a stream of files that come one after the other, by ranges of a number column."""
    spark = rows.sparkSession
    path, (low, high) = scratch(spark, name), rows.agg(F.min(column), F.max(column)).first()
    low, high = (0, 0) if low is None else (low, high)  # no rows: files without any
    for k in range(parts):
        place = F.floor((F.col(column) - low) * parts / (high - low + 1))
        rows.filter(place == k).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(path)


def arriving_in_order(rows: DataFrame, name: str, column: str, parts: int = 3, most: int = 3_000_000) -> DataFrame:
    """rows as a stream whose micro-batches are ranges of a number column, one after the other, of about ``most`` rows if its values are even.

    Rows are written out once by range. Each range is then one file, the next micro-batch, of row groups that tasks share.
    """
    spark = rows.sparkSession
    path, (low, high, n) = scratch(spark, name), rows.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    low, high, parts = (0, 0, 1) if low is None else (low, high, max(parts, -(-n // most)))
    placed = rows.withColumn("__place", F.floor((F.col(column) - low) * parts / (high - low + 1)))
    placed.write.partitionBy("__place").parquet(f"{path}-ranges")
    ranges = spark.read.schema(placed.schema).parquet(f"{path}-ranges")
    for k in range(parts):
        ranges.filter(F.col("__place") == k).drop("__place").coalesce(1).write.option("parquet.block.size", 4 << 20).mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def arrived(stream: DataFrame, name: str) -> tuple[DataFrame, str]:
    """What a stream has written when all its files are read, and its checkpoint."""
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), checkpoint


def memory_stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    memory = spark.createDataFrame(MEMORY, T.MEMORY)
    return arrived(SM.remembered(arriving_in_order(with_memory(spark, d), "memory-rows", "doc_id"), memory), "remembered")


def q_memory_stream(spark, d):
    """Transfers as a stream sees them: what is known before a row, and nothing that comes after it."""
    return memory_stream(spark, d)[0].select("seq", "state", "evidence_type", "match_source", "category_area", "confidence", "fuzzy_match_term", "fuzzy_match_score")


def q_memory_asof(spark, d):
    """What was last known of each transfer's entity before it, by time."""
    times = read_table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return last_evidence(T.own_evidence(T.counterparties(with_memory(spark, d).join(times, "seq")), fuzzy=False), "ts")


def q_memory_state(spark, d):
    """The memory that the stream leaves in its state."""
    return SM.memory_of(spark, memory_stream(spark, d)[1])


def q_dedup_stream(spark, d):
    """Rows that come again an hour later are left out."""
    rows = ledger(spark, d, "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    again = rows.withColumns({"seq": F.col("seq") + 1_000_000_000, "ts": F.expr("ts + interval 1 hour")})
    stream = arriving(rows.unionByName(again), "repeated-rows", "seq", 2)
    return arrived(SD.without_repeats(stream, "ts", "60 days"), "once")[0].select("booking_date", "amount", "direction", "source_section", "raw_description")


def q_mirror_stream(spark, d):
    """Both sides of transfers, the second a day later. A last row far ahead lets the watermark pass all others."""
    rows = with_mirrors(spark, d, "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("ts", F.when(F.col("seq") >= 1_000_000_000, F.expr("ts + interval 1 day")).otherwise(F.col("ts")))
    end = rows.orderBy(F.desc("seq")).limit(1).withColumns({"seq": F.lit(2_000_000_000).cast("long"), "txn_type": F.lit("end"), "ts": F.expr("ts + interval 400 days")})
    stream = arriving(rows.unionByName(end), "both-sides", "seq", 4)
    kept = arrived(SD.without_mirrors(stream, "ts", "60 days"), "one-side")[0]
    return kept.filter("txn_type != 'end'").select("seq", "transaction_id", "direction", "txn_type")


def queries() -> dict:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
