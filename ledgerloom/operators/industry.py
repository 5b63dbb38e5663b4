"""Companies and industries: best registry row for a name, its codes, their names, and code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from ..runtime import keep
from .classify import lookup
from .merchants import common_atoms, postings


def industry_code(code: Column) -> Column:
    """The first four digits, zero-padded; null without any digit."""
    return F.lpad(F.substring(F.nullif(F.regexp_replace(code.cast("string"), r"\D", ""), F.lit("")), 1, 4), 4, "0")


def expense_category(code: Column) -> Column:
    code = industry_code(code)
    return F.coalesce(lookup(code, R.CODE_CATEGORY), lookup(F.substring(code, 1, 2), R.PREFIX_CATEGORY))


def impulse_category(code: Column) -> Column:
    code = industry_code(code)
    return F.coalesce(lookup(code, R.CODE_IMPULSE), lookup(F.substring(code, 1, 2), R.PREFIX_IMPULSE), F.lit("Other"))


def lifetime_bucket(code: Column) -> Column:
    return lookup(industry_code(code), R.CODE_LIFETIME)


def primary_category(df: DataFrame, key: str, code: str) -> DataFrame:
    """key and the most frequent category of its codes; ties by the fixed order, null if no code has one."""
    rank = {c: k for k, c in enumerate(R.PRIMARY_ORDER)}
    counts = df.withColumn("__c", expense_category(F.col(code))).groupBy(key, "__c").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("__c", F.when(F.col("__c").isNotNull(), F.struct("n", (-F.coalesce(lookup(F.col("__c"), rank), F.lit(999))).alias("r"))))
    return counts.groupBy(key).agg(best.alias("primary_category"))


#: Firms that may share a key before they are taken by classes of equal common keys.
COMMON = 150


def firm_pairs(q: DataFrame, f: DataFrame, common: int = COMMON) -> DataFrame:
    """query, firm_id: pairs among which the best firm of each query is, however many firms share a token.

    A firm that shares a key (a token or a prefix) of up to ``common`` firms is taken. Of the firms that share commoner keys alone,
    those with the same common keys differ for a query only by their number of tokens and by whether their name contains the
    query's. So the one of fewest tokens, and lowest number, stands for its class; and names that contain a query's are found by equality
    with a part of that length.
    """
    asked = q.select("query", F.explode("q_keys").alias("atom"))
    owned = keep(postings(f, "firm_id", F.col("f_keys"), asked), "firm-keys")
    hot = keep(common_atoms(owned, common), "common-keys")
    rare = asked.join(hot, "atom", "left_anti").join(owned, "atom").select("query", "firm_id")
    of_firm = owned.join(hot, "atom").groupBy("firm_id").agg(F.array_sort(F.collect_set("atom")).alias("common"))
    busy = f.join(of_firm, "firm_id")
    classes = busy.groupBy("common").agg(F.min(F.struct(F.size("f_tokens").alias("n"), "firm_id")).alias("first"))
    open_ = asked.join(hot, "atom")
    alike = open_.join(classes.select(F.col("first.firm_id").alias("firm_id"), F.explode("common").alias("atom")), "atom").select("query", "firm_id")
    # Queries with a common key, by the length of their name: lengths are few, however many names there are.
    some = q.join(open_.select("query").distinct(), "query", "left_semi").select("query", "q_norm", "q_keys")
    lengths = [r.n for r in some.select(F.length("q_norm").alias("n")).distinct().collect()]
    if not lengths:
        return rare.distinct()
    cut = lambda n: F.when(F.length("f_norm") >= n, F.transform(F.sequence(F.lit(1), F.length("f_norm") - n + 1), lambda k: F.substring("f_norm", k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = busy.select("firm_id", "f_keys", F.explode(F.array_distinct(F.flatten(F.array(*map(cut, sorted(lengths)))))).alias("q_norm"))
    inside = parts.join(some, "q_norm").filter(F.arrays_overlap("q_keys", "f_keys"))
    # All have 0.97 or more, and those with more share all tokens and are no longer: a class of its own finds them.
    held = inside.groupBy("query").agg(F.min("firm_id").alias("firm_id"))
    return rare.unionByName(alike).unionByName(held).distinct()


def best_firm(queries: DataFrame, firms: DataFrame, least: float = 0.5, common: int = COMMON) -> DataFrame:
    """query, firm_id, score: by shared tokens or prefixes, 0.97 at least if the firm's name contains the query.

    queries: query. firms: firm_id, name. Equal scores go to the smallest firm_id.
    """
    keys = lambda tokens: F.concat(F.transform(tokens, lambda t: F.concat(F.lit("="), t)), X.prefixes(F.col(tokens)))
    q = queries.select("query").distinct().withColumn("q_norm", X.registry_name(F.coalesce("query", F.lit(""))))
    q = q.withColumn("q_tokens", X.name_tokens(F.col("q_norm"), False)).filter(F.size("q_tokens") > 0).withColumn("q_keys", keys("q_tokens"))
    f = firms.select("firm_id", X.registry_name(F.coalesce("name", F.lit(""))).alias("f_norm")).withColumn("f_tokens", X.name_tokens(F.col("f_norm"), False))
    f = f.withColumn("f_keys", keys("f_tokens"))
    rows = firm_pairs(q, f, common).join(q, "query").join(f, "firm_id")
    shared = F.size(F.array_intersect("q_tokens", "f_tokens"))
    overlap = F.greatest(shared, F.lit(1)).cast("double")
    score = 0.65 * (overlap / F.size("q_tokens")) + 0.35 * (overlap / F.greatest(F.lit(1), F.size("f_tokens")))
    score = F.when(F.col("f_norm").contains(F.col("q_norm")), F.greatest(score, F.lit(0.97))).otherwise(score)
    best = rows.withColumn("score", score).groupBy("query").agg(F.max(F.struct("score", (-F.col("firm_id")).alias("k"))).alias("b"))
    return best.filter(F.col("b.score") >= least).select("query", (-F.col("b.k")).alias("firm_id"), F.col("b.score").alias("score"))


def firm_codes(firms: DataFrame, codes: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, code, description, industry: the distinct codes of each firm.

    firms: key. codes: key, code. names: class, name; the first named row of a class counts (by its column seq).
    """
    four = F.lpad(F.coalesce("code", F.lit("")), 4, "0")
    own = firms.select(key).distinct().join(codes.select(key, F.when(F.length(F.coalesce("code", F.lit(""))) > 4, F.col("code")).otherwise(four).alias("code")).distinct(), key)
    named = names.filter("class is not null and name is not null and trim(name) != ''").groupBy("class").agg(F.min_by("name", "seq").alias("description"))
    rows = own.join(named.withColumnRenamed("class", "code"), "code", "left")
    return rows.select(key, "code", "description", F.coalesce(lookup(F.col("code"), R.INDUSTRY_OVERRIDES), "description", F.lit(R.UNKNOWN_INDUSTRY)).alias("industry"))


def resolve(queries: DataFrame, firms: DataFrame, external: DataFrame) -> DataFrame:
    """query, source (onrc, termene or not_found), name, cui: the registry first, then the external lookup."""
    found = best_firm(queries, firms).join(firms.select("firm_id", "name", "cui"), "firm_id").select("query", F.lit("onrc").alias("source"), "name", "cui")
    rest = queries.select("query").distinct().join(found.select("query"), "query", "left_anti")
    outside = rest.withColumn("query_norm", X.registry_name(F.coalesce("query", F.lit("")))).join(external, "query_norm", "left")
    outside = outside.select("query", F.when(F.col("name").isNotNull(), "termene").otherwise("not_found").alias("source"), "name", "cui")
    return found.unionByName(outside)


def entries(resolved: DataFrame, codes: DataFrame) -> DataFrame:
    """One row for each company with its sorted codes as an array of structs."""
    listed = codes.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("code", "description", "industry"))).alias("entries"))
    return resolved.join(listed, "query", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<code:string,description:string,industry:string>>")))


def feature_sources(columns: list[str]) -> dict[str, str]:
    """Where each model feature comes from: statements, the questionnaire, or nowhere."""
    statement = set(R.statement_features())
    profile = {f for options in [*R.QUESTIONS.values(), *R.MULTI_QUESTIONS.values()] for f in options.values()} | {f for f, _ in R.ORDINAL_QUESTIONS.values()} | set(R.NUMERIC_FEATURES)
    return {c: "program_2" if c in statement else "questionnaire" if c in profile else "ignore" for c in columns}


def required_features(columns: list[str], statement: list[str]) -> dict[str, list[str]]:
    """What a model still needs: statement features that ``statement`` lacks, and all that the questionnaire gives."""
    sources = feature_sources(columns)
    return {
        "missing_program_features": [c for c in columns if sources[c] == "program_2" and c not in statement],
        "required_profile_features": [c for c in columns if sources[c] == "questionnaire"],
    }


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", rank).filter("__k = 1").drop("__k")
