"""Expense totals, features and final rows: one grouped pass of conditional sums, then projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..runtime import let
from ..sources.tables import month_key

MONEY = "decimal(38,4)"
TOTALS = {
    "Food": "food_total",
    "Housing": "housing_total",
    "Transport": "transport_total",
    "Entertainment": "entertainment_total",
    "Health": "health_total",
    "Personal_Care": "personal_care_total",
    "Child_Education": "child_education_total",
    "Other": "other_total",
}


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("statement_month", month_key(F.col("booking_date")))


def impulse_bucket(category: Column) -> Column:
    merchant = F.coalesce(F.trim("merchant_canonical"), F.lit(""))
    return (
        F.when(merchant.isin(R.ELECTRONICS_MERCHANTS), "electronics_gadgets")
        .when(category == "Personal_Care", "clothing_personal_care")
        .when(category == "Entertainment", "entertainment")
        .when(category == "Food", "food")
        .when(category.isin("Other", "Unknown"), "other")
    )


def spending(df: DataFrame, include_bank_fees: bool = False) -> DataFrame:
    """Adds what the totals need: __amount, __income, __out, __category, __bucket and __impulse."""
    excluded = [t for t in R.EXCLUDED_TYPES if not (include_bank_fees and t == "bank_fee")]
    kind = F.coalesce("txn_type", F.lit(""))
    category = F.coalesce(F.nullif("category_area", F.lit("")), F.lit("Unknown"))
    income = (F.col("direction") == "credit") & ~kind.isin("internal_transfer", "blocked_amount")
    settled = (kind != "external_transfer") | (~F.coalesce("state", F.lit("")).isin("excluded", "unknown") & (category != "Unknown"))
    amount = F.abs("amount").cast(MONEY)
    bucket = impulse_bucket(category)
    impulse = ~kind.isin(R.IMPULSE_EXCLUDED_TYPES) & ~category.isin(R.IMPULSE_EXCLUDED_CATEGORIES) & (amount <= R.IMPULSE_MOST) & bucket.isNotNull()
    impulse = impulse & ((bucket != "food") | F.coalesce("merchant_canonical", F.lit("")).isin(R.QUICK_FOOD_MERCHANTS))
    out = (F.col("direction") == "debit") & ~kind.isin(excluded) & settled
    return df.withColumns({"__amount": amount, "__income": F.coalesce(income, F.lit(False)), "__out": F.coalesce(out, F.lit(False)), "__category": category, "__bucket": bucket, "__impulse": F.coalesce(out & impulse, F.lit(False))})


def total_columns() -> list[Column]:
    """The 26 totals over the columns of spending()."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.bround(F.sum(F.when(condition, F.col("__amount"))), 2), F.lit(0)).cast("double")

    def count(condition: Column) -> Column:
        return F.count_if(condition).cast("double")

    out, category, bucket = F.col("__out"), F.col("__category"), F.col("__bucket")
    columns = [total(out & (category == c)).alias(name) for c, name in TOTALS.items()]
    columns.append(total(out & ~category.isin(list(TOTALS))).alias("unknown_total"))
    columns.append(total(out & F.coalesce("merchant_canonical", F.lit("")).isin(R.ELECTRONICS_MERCHANTS)).alias("electronics_gadgets_total"))
    columns.append(total(F.col("__income")).alias("income_total"))
    columns.append(total(out).alias("outgoing_expense_total"))
    columns.append(total(out & category.isin(R.ESSENTIAL)).alias("essential_total"))
    columns.append(total(out & ~category.isin(R.ESSENTIAL)).alias("nonessential_total"))
    columns.append(count(out).alias("outgoing_tx_count"))
    columns.append(count(F.col("__impulse")).alias("impulse_candidate_tx_count"))
    columns += [total(F.col("__impulse") & (bucket == b)).alias(f"impulse_spend_{b}") for b in R.IMPULSE_BUCKETS]
    columns += [count(F.col("__impulse") & (bucket == b)).alias(f"impulse_tx_count_{b}") for b in R.IMPULSE_BUCKETS]
    return columns


def expense_totals(df: DataFrame, *keys: str, include_bank_fees: bool = False) -> DataFrame:
    return spending(df, include_bank_fees).groupBy(*keys).agg(*total_columns())


def expense_totals_with_overall(df: DataFrame, *keys: str) -> DataFrame:
    """Totals of each group and of each first key, in one pass of grouping sets; the last key is null overall."""
    rows = spending(df)
    return rows.groupingSets([list(keys), list(keys[:-1])], *keys).agg(*total_columns())


def percentages() -> Column:
    """An array of the eight shares, which add up to 100: the rest of rounding goes to the largest amount (then name)."""
    amounts = F.array(*[F.struct(F.greatest(F.lit(0.0), F.col(TOTALS[c])).alias("a"), F.lit(f"Expense_Distribution_{c}").alias("c")) for c in R.DISTRIBUTION])
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def shares(amounts: Column) -> Column:
        total = add(F.transform(amounts, lambda x: x["a"]))
        raw = let(total, lambda t: F.transform(amounts, lambda x: F.struct(F.when(t <= 0, 0.0).otherwise(F.bround(F.try_divide(x["a"], t) * 100, 4)).alias("v"), x["c"].alias("c"), (t <= 0).alias("none"))))
        return let(raw, lambda r: fitted(r, F.array_max(amounts)["c"]))

    def fitted(raw: Column, target: Column) -> Column:
        delta = F.bround(100 - add(F.transform(raw, lambda x: x["v"])), 4)
        return let(delta, lambda d: F.transform(raw, lambda x: F.when(x["none"], 0.0).when((d != 0) & (x["c"] == target), F.bround(F.greatest(F.lit(0.0), x["v"] + d), 4)).otherwise(x["v"])))

    return let(amounts, shares)


def with_shares(totals: DataFrame) -> DataFrame:
    rows = totals.withColumn("__shares", percentages())
    return rows.withColumns({f"Expense_Distribution_{c}": F.get("__shares", F.lit(k)) for k, c in enumerate(R.DISTRIBUTION)}).drop("__shares")


def distribution_percent(totals: DataFrame, *keys: str) -> DataFrame:
    return with_shares(totals).select(*keys, *[f"Expense_Distribution_{c}" for c in R.DISTRIBUTION])


def impulse_flags() -> dict[str, Column]:
    """One flag at most: the bucket of most candidates, then of most spending, then the first."""
    scored = []
    for k, (name, bucket) in enumerate(R.IMPULSE_CATEGORIES.items()):
        n, spend = (F.greatest(F.lit(0.0), F.col(f"impulse_{x}_{bucket}")) for x in ("tx_count", "spend"))
        if bucket == "electronics_gadgets":
            has = F.col("electronics_gadgets_total") > 0
            n, spend = F.when(has, F.greatest(n, F.lit(1.0))).otherwise(n), F.when(has, F.greatest(spend, F.col("electronics_gadgets_total"))).otherwise(spend)
        scored.append(F.struct(n.alias("n"), spend.alias("s"), F.lit(-k).alias("k"), F.lit(name).alias("c")))
    winner = let(F.array_max(F.array(*scored)), lambda b: F.when((b["n"] > 0) | (b["s"] > 0), b["c"]).otherwise(""))
    return {f"Impulse_Buying_Category_{c}": (winner == c).cast("int") for c in R.IMPULSE_CATEGORIES}


def frequency_band(ratio: Column) -> Column:
    return F.when(ratio <= 0, 0).when(ratio <= 0.20, 1).when(ratio <= 0.45, 2).when(ratio <= 0.75, 3).otherwise(4)


def behaviour_band(score: Column) -> Column:
    return F.when(score <= -0.10, "Healthy").when(score <= 0.20, "Moderate").when(score.isNotNull(), "Risky")


def feature_vector(totals: DataFrame, *keys: str) -> DataFrame:
    """keys and the 19 features of the 26 totals; all zero without any spending."""
    rows = with_shares(totals)
    d = lambda *names: F.bround(sum((F.col(f"Expense_Distribution_{n}") for n in names), F.lit(0.0)), 4)
    known = sum((F.greatest(F.lit(0.0), F.col(t)) for t in TOTALS.values()), F.lit(0.0))
    unknown = F.greatest(F.lit(0.0), F.col("unknown_total"))
    saves = (F.col("income_total") - F.col("outgoing_expense_total") > 0).cast("int")
    ratio = F.try_divide(F.col("impulse_candidate_tx_count"), F.col("outgoing_tx_count"))
    features = {
        **{f"Expense_Distribution_{c}": F.col(f"Expense_Distribution_{c}") for c in R.DISTRIBUTION},
        "Unknown_Expense_Percentage": F.bround(F.try_divide(unknown, known + unknown) * 100, 4),
        "Essential_Needs_Percentage": d("Food", "Housing", "Transport", "Health", "Personal_Care", "Child_Education"),
        "Discretionary_Spending_Percentage": d("Entertainment", "Other"),
        "Save_Money_No": 1 - saves,
        "Save_Money_Yes": saves,
        "Impulse_Buying_Frequency": F.coalesce(F.when(ratio.isNotNull(), frequency_band(ratio)), F.lit(0)),
        **impulse_flags(),
    }
    empty = known + unknown <= 0
    return rows.select(*keys, *[F.when(empty, F.lit(0)).otherwise(c).cast("double" if "Percentage" in n or "Distribution" in n else "int").alias(n) for n, c in features.items()])


def final_row(features: DataFrame, *keys: str, income: str | None = None, profile: list[str] | None = None) -> DataFrame:
    """keys and the 64 final columns: shares as flags at 5 %, income, the profile's columns where features has them."""
    have = set(features.columns)
    out = []
    for name in R.final_columns():
        kind = "string" if name == "Behavior_Risk_Level" else "double" if name in R.REAL_COLUMNS else "int"
        if name == "Income_Category":
            column = F.col(income) if income else F.lit(None)
        elif name.startswith("Expense_Distribution_"):
            column = (F.col(name) >= R.DISTRIBUTION_LEAST).cast("int")
        elif name in R.feature_columns():
            column = F.col(f"`{name}`")
        elif name in (profile or []) and name in have:
            column = F.col(f"`{name}`")
        else:
            column = F.lit(None)
        out.append(column.cast(kind).alias(name))
    return features.select(*keys, *out)


def salary_metrics(df: DataFrame, *keys: str) -> DataFrame:
    salary = (F.col("txn_type") == "salary_income") & (F.col("direction") == "credit")
    total = F.coalesce(F.bround(F.sum(F.when(salary, F.abs("amount").cast(MONEY))), 2), F.lit(0)).cast("double")
    return df.groupBy(*keys).agg((F.count_if(salary) > 0).alias("salary_income_detected"), F.count_if(salary).alias("salary_income_count"), total.alias("salary_income_total"))


def transfer_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Ten counts over transfers and salaries, by source and state."""
    own = F.col("txn_type").isin("internal_transfer", "external_transfer", "salary_income")
    source = lambda *s: F.count_if(own & F.col("match_source").isin(*s))
    state = lambda *s: F.count_if(own & F.col("state").isin(*s))
    sure = lambda *s: F.count_if(own & F.col("match_source").isin(*s) & (F.col("state") == "confirmed"))
    memory, back = "entity_memory", "entity_memory_backfill"
    return df.groupBy(*keys).agg(
        source(memory, back).alias("entity_memory_hits"),
        source(memory).alias("entity_memory_direct_hits"),
        source(back).alias("entity_memory_backfill_hits"),
        source("bootstrap_exact").alias("bootstrap_exact_hits"),
        source("bootstrap_fuzzy").alias("bootstrap_fuzzy_hits"),
        state("candidate").alias("candidate_count"),
        sure(memory, back).alias("confirmed_by_memory"),
        sure("recurrence").alias("confirmed_by_recurrence"),
        source(back).alias("backfilled_transactions"),
        state("unknown", "candidate").alias("remaining_unknown_transfers"),
    )


def kpi_block(df: DataFrame, *keys: str) -> DataFrame:
    """Key figures of each group: from the same totals that the features use, and open transfers."""
    open_ = F.col("txn_type").isin("external_transfer", "internal_transfer") & F.col("state").isin("unknown", "candidate")
    totals = spending(df).groupBy(*keys).agg(*total_columns(), F.count_if(open_).alias("unknown_transfer_count"))
    rows = with_shares(totals)
    return rows.select(
        *keys,
        F.lit(True).alias("save_money_computed"),
        F.col("impulse_candidate_tx_count").cast("long").alias("impulse_candidates_count"),
        F.coalesce(F.bround(F.try_divide("impulse_candidate_tx_count", "outgoing_tx_count"), 4), F.lit(0.0)).alias("impulse_frequency"),
        *[F.col(f"impulse_tx_count_{b}").cast("long").alias(f"impulse_count_{b}") for b in R.IMPULSE_BUCKETS],
        F.col("housing_total").alias("housing_detected_amount"),
        "unknown_transfer_count",
        F.bround("Expense_Distribution_Other", 4).alias("other_spend_share"),
    )


def quality_metrics(df: DataFrame, *keys: str) -> DataFrame:
    own = F.col("txn_type").isin(R.MERCHANT_TYPES)
    has = F.coalesce("merchant_raw", F.lit("")) != ""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transactions_extracted_count"),
        F.count_if(F.col("source_section") == "booked_transactions").alias("booked_transactions_count"),
        F.count_if(F.col("source_section") == "blocked_amounts").alias("blocked_transactions_count"),
        F.count_if(own & has).alias("merchant_extracted_count"),
        F.count_if(own & ~has).alias("merchant_unknown_count"),
        F.count_if(own & (F.col("category_area") == "Unknown")).alias("category_unknown_count"),
    )


def label_accuracy(df: DataFrame, labels: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The share of labelled rows on which each field agrees, null without labels; the last duplicate (by seq) counts."""
    rows = df.groupBy(key).agg(*[F.max_by(f, "seq").alias(f) for f in fields])
    both = rows.join(labels.select(key, *[F.col(f).alias(f"__{f}") for f in fields]), key)
    return both.agg(*[F.bround(F.avg(F.when(F.col(f"__{f}").isNotNull(), F.coalesce(F.col(f) == F.col(f"__{f}"), F.lit(False)).cast("int"))), 4).alias(f"{f}_accuracy") for f in fields])


def profile_hash(df: DataFrame, *keys: str) -> DataFrame:
    """keys and 12 hex digits of the hash of the sorted distinct account numbers; without any, of the keys."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce("raw_description", F.lit("")), F.lit(r"(?iu)\b(RO\d{2}[A-Z0-9]{10,30})\b"), F.lit(1)), F.upper)
    found = df.select(*keys, numbers.alias("n")).groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("n")))).alias("n"))
    source = F.when(F.size("n") > 0, F.array_join("n", "|")).otherwise(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return found.select(*keys, F.concat(F.lit("profile-"), F.substring(F.sha2(source, 256), 1, 12)).alias("profile_id"))
