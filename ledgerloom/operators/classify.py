"""Transaction types, channels and their summary: an ordered cascade of rules, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import collapsed, contains_any
from ..runtime import let


def cascade(steps: list[tuple[Column, dict]], default: dict, types: dict[str, str]) -> Column:
    """A struct by the first condition that holds; values are columns or literals, cast to ``types``."""

    def value(fields: dict) -> Column:
        return F.struct(*[(fields[n] if isinstance(fields[n], Column) else F.lit(fields[n])).cast(t).alias(n) for n, t in types.items()])

    out = None
    for condition, fields in steps:
        out = F.when(condition, value(fields)) if out is None else out.when(condition, value(fields))
    return out.otherwise(value(default)) if out is not None else value(default)


TYPE_FIELDS = {"channel": "string", "txn_type": "string", "confidence": "double"}


def transaction_type(description: Column, section: Column, direction: Column) -> Column:
    return let(F.upper(F.coalesce(description, F.lit(""))), lambda upper: _type_of(upper, section, direction))


def _type_of(upper: Column, section: Column, direction: Column) -> Column:
    without_fragment = F.regexp_replace(upper, f"(?iu){R.FEE_FRAGMENT}", " ")
    row = lambda channel, kind, confidence: {"channel": channel, "txn_type": kind, "confidence": confidence}
    return cascade(
        [
            (section == "blocked_amounts", row("BLOCKED", "blocked_amount", 0.99)),
            ((direction == "credit") & contains_any(upper, R.salary_hints()), row("TRANSFER", "salary_income", 0.98)),
            (contains_any(upper, R.ATM_HINTS), row("ATM", "cash_withdrawal", 0.97)),
            (contains_any(without_fragment, R.FEE_HINTS), row("FEE", "bank_fee", 0.96)),
            (contains_any(upper, R.internal_hints()), row("TRANSFER", "internal_transfer", 0.94)),
            (contains_any(upper, R.EXTERNAL_HINTS), row("TRANSFER", "external_transfer", 0.93)),
            (contains_any(upper, R.POS_HINTS), row(F.when(upper.contains("EPOS"), "EPOS").otherwise("POS"), "card_purchase", 0.92)),
        ],
        row("OTHER", "unknown", 0.55),
        TYPE_FIELDS,
    )


def classify_types(df: DataFrame) -> DataFrame:
    """Adds channel, txn_type and confidence."""
    kind = transaction_type(F.col("raw_description"), F.col("source_section"), F.col("direction"))
    return df.withColumn("__type", kind).withColumns({n: F.col(f"__type.{n}") for n in TYPE_FIELDS}).drop("__type")


def type_summary(df: DataFrame, *keys: str) -> DataFrame:
    total, valid = F.count(F.lit(1)), F.count_if(F.col("txn_type") != "unknown")
    return df.groupBy(*keys).agg(total.alias("total"), valid.alias("valid"), F.coalesce(F.bround(F.try_divide(valid, total), 4), F.lit(0.0)).alias("valid_rate"))


def merchant_text(description: Column, noise: list[str] | None = None) -> Column:
    """The merchant's spelling in a description, or null. ``noise``: further phrases to leave out."""
    no_case = lambda p: f"(?iu){p}"
    text = F.regexp_replace(F.coalesce(description, F.lit("")), no_case(R.URL), " ")
    for pattern in [*R.REFERENCES, *(noise or []), *R.FEE_PHRASES, R.AMOUNT_WITH_CURRENCY]:
        text = F.regexp_replace(text, no_case(pattern), " ")
    text = F.regexp_replace(F.regexp_replace(text, no_case(R.LEADING_BOILERPLATE), ""), no_case(R.TRAILING_NOISE), "")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " "), F.lit(" -:;,")), F.lit(""))


def merchant_of(text: Column) -> Column:
    """The merchant of a cleaned text: gateways and brands first, else its words without technical ones and places."""
    no_case = lambda p: f"(?iu){p}"
    found = F.when(text.rlike(no_case(R.PAYMENT_GATEWAY)), F.regexp_extract(text, no_case(R.PAYMENT_GATEWAY), 0))
    for pattern, name in R.FIRST_BRANDS:
        found = found.when(text.rlike(no_case(pattern)), name)
    shop = F.regexp_extract(text, no_case(R.BRAND_WITH_SHOP), 0)
    found = found.when(text.rlike(no_case(R.BRAND_WITH_SHOP)), F.trim(F.regexp_replace(shop, r"\s+\d{2,6}.*$", "")))
    for pattern, name in R.BRANDS:
        found = found.when(text.rlike(no_case(pattern)), name)
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9*./&@\s-]", " "), r"\s+", " ")), " ")
    kept = F.array_join(F.filter(words, lambda w: ~F.upper(w).isin(R.TECHNICAL_TOKENS)), " ")
    tail = "|".join(R.LOCATION_TOKENS)
    return found.otherwise(F.nullif(F.trim(F.regexp_replace(kept, f"(?i)(?:(?:^| )(?:{tail}|[0-9]+))+$", "")), F.lit("")))


def extract_merchants(df: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """Adds merchant_raw, null for types without merchants."""
    found = let(merchant_text(F.col("raw_description"), noise), lambda t: F.when(t.isNotNull(), merchant_of(t)))
    return df.withColumn("merchant_raw", F.when(F.col("txn_type").isin(R.MERCHANT_TYPES), found))


def lookup(column: Column, table: dict) -> Column:
    """A fixed table as one map expression."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def map_categories(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Adds category_area and mapping_method from merchant_canonical and txn_type, as without any cache.

    rules: ``merchants``, ``patterns`` and ``types`` as category_rules reads them; the fixed ones without.
    """
    rules = rules or {"merchants": R.MERCHANT_CATEGORIES, "patterns": R.CATEGORY_PATTERNS, "types": R.CATEGORY_BY_TYPE}
    merchant = F.trim("merchant_canonical")
    exact = lookup(merchant, rules["merchants"])
    by_type = lookup(F.col("txn_type"), rules["types"])
    method = F.col("mapping_method") if "mapping_method" in df.columns else F.lit(None).cast("string")
    steps = [
        (~F.col("txn_type").isin(R.MERCHANT_TYPES), {"category": F.lit(None), "method": method}),
        (merchant.isNull() | (merchant == ""), {"category": "Unknown", "method": "unmapped"}),
        (exact.isNotNull(), {"category": exact, "method": F.when(method.isin("exact_alias", "fuzzy_alias"), method).otherwise("exact_alias")}),
        *[(merchant.rlike(f"(?iu){p}"), {"category": c, "method": "regex_rule"}) for p, c in rules["patterns"]],
        (by_type.isNotNull(), {"category": by_type, "method": "fallback_rule"}),
    ]
    made = cascade(steps, {"category": "Unknown", "method": "unmapped"}, {"category": "string", "method": "string"})
    return df.withColumn("__map", made).withColumns({"category_area": F.col("__map.category"), "mapping_method": F.col("__map.method")}).drop("__map")


def category_summary(df: DataFrame, *keys: str) -> DataFrame:
    eligible = F.count_if(F.col("txn_type").isin(R.MERCHANT_TYPES))
    unknown = F.count_if(F.col("txn_type").isin(R.MERCHANT_TYPES) & (F.col("category_area") == "Unknown"))
    return df.groupBy(*keys).agg(eligible.alias("eligible_for_category"), unknown.alias("unknown_category"), F.coalesce(F.bround(F.try_divide(unknown, eligible), 4), F.lit(0.0)).alias("unknown_rate"))


def low(text: Column) -> Column:
    return collapsed(F.lower(F.coalesce(text, F.lit(""))))


def row_flags(df: DataFrame) -> DataFrame:
    """Adds the eight derived columns of a classified row, and classification_confidence."""
    merchant = low(F.col("merchant_canonical"))
    kind = F.coalesce("txn_type", F.lit(""))
    final = F.coalesce(F.nullif("category_area", F.lit("")), F.lit("Unknown"))
    essential = final.isin(R.ESSENTIAL)
    nonessential = (F.col("direction") == "debit") & ~kind.isin("internal_transfer", "salary_income", "bank_fee", "blocked_amount", "cash_withdrawal") & ~essential
    bucket = (
        F.when(F.col("category_area") == "Personal_Care", "clothing_personal_care")
        .when(merchant.isin([m.lower() for m in R.ELECTRONICS_MERCHANTS]), "electronics_gadgets")
        .when(F.col("category_area") == "Entertainment", "entertainment")
        .when((F.col("category_area") == "Food") & merchant.isin([m.lower() for m in R.QUICK_FOOD_MERCHANTS]), "food")
        .when(F.col("category_area").isin("Other", "Unknown"), "other")
    )
    utility = contains_any(merchant, R.UTILITY_TERMS)
    candidate = nonessential & (final != "Housing") & ~utility & ~kind.isin("external_transfer", "internal_transfer", "bank_fee") & bucket.isNotNull() & (F.abs("amount") <= R.IMPULSE_MOST)
    return df.withColumns(
        {
            "final_spend_category": final,
            "is_essential": essential,
            "is_nonessential": F.coalesce(nonessential, F.lit(False)),
            "is_internal_transfer": kind == "internal_transfer",
            "is_salary": kind == "salary_income",
            "is_housing": final == "Housing",
            "is_utility": utility,
            "is_impulse_candidate": F.coalesce(candidate, F.lit(False)),
            "impulse_category": F.when(candidate, bucket),
            "classification_confidence": F.col("confidence"),
        }
    )


def classification_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of extracted and normalised merchants by source, and of transfer outcomes."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    source = lambda s: F.count_if(F.col("normalization_source") == s)
    return df.groupBy(*keys).agg(
        has("merchant_raw").alias("merchant_extracted"),
        has("merchant_canonical").alias("merchant_normalized"),
        source("dataset").alias("merchant_normalized_from_dataset"),
        source("termene").alias("merchant_normalized_from_external"),
        F.count_if(F.col("normalization_source").startswith("alias_")).alias("merchant_normalized_from_alias"),
        source("unmapped").alias("merchant_normalized_unmapped"),
        F.count_if(F.col("state") == "candidate").alias("transfer_candidate_count"),
        F.count_if(F.col("match_source") == "bootstrap_exact").alias("transfer_bootstrap_exact_hits"),
        F.count_if(F.col("match_source") == "bootstrap_fuzzy").alias("transfer_bootstrap_fuzzy_hits"),
    )


def merged_summaries(df: DataFrame, *keys: str) -> DataFrame:
    """Sums of total, valid and unknown_category; the rates anew over the total, null if there is none."""
    total, valid, unknown = F.sum("total"), F.sum("valid"), F.sum("unknown_category")
    rate = lambda x: F.bround(F.try_divide(x, total), 4)
    return df.groupBy(*keys).agg(total.alias("total"), valid.alias("valid"), unknown.alias("unknown_category"), rate(valid).alias("valid_rate"), rate(unknown).alias("unknown_rate"))
