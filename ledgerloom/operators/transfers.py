"""Transfers: counterparties, dictionary evidence, and keyed memory as windows instead of a running dictionary.

A row's own evidence ignores memory. For each entity the first confirming row, in the order of documents and rows,
becomes its memory: later rows take it, earlier rows of the same document that stayed open are filled back from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.similarity import TermTable
from ..functions.text import plain
from ..runtime import keep, left_join_spread, let
from ..sources.tables import month_key
from .merchants import containing

IBAN = r"(?iu)\bRO\d{2}[A-Z0-9]{10,30}\b"
AREAS = {"housing": "Housing", "utilities": "Housing", "salary_income": "Other", "internal_transfer": "Other"}
TRANSFER_TYPES = ["internal_transfer", "external_transfer", "salary_income"]
MEMORY = "entity_key string, canonical_name string, category string, confidence double, status string, first_seen string, last_seen string, months_seen int, evidence_type string"


def normalised(term: str) -> str:
    """A dictionary term as descriptions are normalised (terms have no accents): noise words go."""
    words = "".join(c if c.isalnum() and c.isascii() else " " for c in term.lower()).split()
    return " ".join(w for w in words if w.upper() not in R.NOISE_TOKENS)


def terms_of(category: str, terms: dict | None = None) -> list[str]:
    rule = (terms or R.TRANSFER_TERMS)[category]
    return [t for key in ("exact_terms", "transfer_terms", "recipient_terms") for t in rule.get(key, [])]


def counterparties(df: DataFrame) -> DataFrame:
    """Adds recipient_iban, recipient_name and entity_key to transfer rows, and helper columns with __."""
    text = F.coalesce("raw_description", F.lit(""))
    chunks = F.filter(F.transform(F.split(text, ";"), lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), lambda c: c != "")
    is_transfer = F.col("txn_type").isin(TRANSFER_TYPES)
    rows = df.withColumn("__chunks", chunks)
    rows = rows.withColumns(
        {
            "recipient_iban": F.when(is_transfer, F.nullif(F.upper(F.regexp_extract(text, IBAN, 0)), F.lit(""))),
            "recipient_name": F.when(is_transfer, F.coalesce(F.get("__chunks", F.lit(1)), F.get("__chunks", F.lit(0)))),
        }
    ).drop("__chunks")
    rows = rows.withColumns({"__recipient": plain(F.col("recipient_name")), "__text": plain(text)})
    key = F.coalesce("recipient_iban", F.nullif("__recipient", F.lit("")), F.nullif(F.substring("__text", 1, 64), F.lit("")))
    return rows.withColumn("entity_key", F.when(is_transfer, key))


def dictionary_match(haystack: Column) -> Column:
    """A struct of category and term: the first category without a negative term that has a term in the text."""
    return let(haystack, _dictionary_match)


def _dictionary_match(haystack: Column) -> Column:
    out = None
    for category, rule in R.TRANSFER_TERMS.items():
        negative = F.lit(False)
        for t in filter(None, map(normalised, rule["negative_terms"])):
            negative = negative | haystack.contains(t)
        term = None
        for raw in terms_of(category):
            if t := normalised(raw):
                term = F.when(haystack.contains(t), raw) if term is None else term.when(haystack.contains(t), raw)
        hit = F.when(~negative & term.isNotNull(), F.struct(F.lit(category).alias("category"), term.alias("term")))
        out = hit if out is None else F.coalesce(out, hit)
    return out


def dictionary_rows(terms: dict) -> list[tuple]:
    """A dictionary as rows: rank of the category, category, place of the term, term, its normalised form, whether it speaks against."""
    out = []
    for rank, (category, rule) in enumerate(terms.items()):
        out += [(rank, category, k, t, normalised(t), False) for k, t in enumerate(terms_of(category, terms)) if normalised(t)]
        out += [(rank, category, -1, t, normalised(t), True) for t in rule.get("negative_terms") or [] if normalised(t)]
    return out


def dictionary_table(spark, terms: dict) -> DataFrame:
    return spark.createDataFrame(dictionary_rows(terms), "rank int, category string, place int, term string, norm string, against boolean")


def dictionary_join(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """rows with __exact, as dictionary_match gives it, from a dictionary in rows: the plan does not grow with its terms.

    Texts meet the terms that they contain; a category with a term against it goes, and of the others the first term of the first counts.
    """
    found = containing(rows.select(F.col(column).alias("__hay")).filter("__hay != ''").distinct(), "__hay", table, "norm")
    each = found.groupBy("__hay", "rank", "category").agg(F.bool_or("against").alias("against"), F.min(F.when(~F.col("against"), F.struct("place", "term"))).alias("first"))
    each = each.filter(~F.col("against") & F.col("first").isNotNull())
    best = each.groupBy("__hay").agg(F.min(F.struct("rank", "category", F.col("first.term").alias("term"))).alias("b"))
    named = best.select(F.col("__hay").alias(column), F.struct("b.category", "b.term").alias("__exact"))
    return left_join_spread(rows, named, column, "doc_id", "seq")


def similar_terms(terms: dict | None = None) -> list[tuple[str, str]]:
    """Category and normalised term of the categories that allow similar ones, in order."""
    terms = terms or R.TRANSFER_TERMS
    return [(c, normalised(t)) for c, rule in terms.items() if rule.get("fuzzy") for t in terms_of(c, terms) if t.strip()]


def fuzzy_terms(texts: DataFrame, column: str, table: list[tuple[str, str]] | None = None) -> DataFrame:
    """column, category, term, score: the first best term (category, normalised term) by distinct text; a batch of texts is compared at once."""
    table = [(c, t) for c, t in (similar_terms() if table is None else table) if t]

    def best(frames):
        import pandas as pd

        terms = TermTable([t for _, t in table])
        for frame in frames:
            which, score = terms.best(frame[column].tolist())
            pick = lambda k: [table[w][k] if w >= 0 else None for w in which]
            yield pd.DataFrame({column: frame[column], "category": pick(0), "term": pick(1), "score": pd.Series(score).where(which >= 0)})

    distinct = texts.select(column).filter(F.col(column) != "").distinct()
    return distinct.mapInPandas(best, f"{column} string, category string, term string, score double")


def own_evidence(df: DataFrame, fuzzy: bool = True, terms: dict | None = None) -> DataFrame:
    """Adds __own, the evidence of each external or salary row by itself (null for other rows).

    terms: a dictionary in the form of TRANSFER_TERMS, of any size; a category of its own has the area Other.
    """
    hay = F.trim(F.concat_ws(" ", "__recipient", "__text"))
    if terms is None:
        rows = df.withColumn("__exact", dictionary_match(hay))
    else:
        rows = dictionary_join(df.withColumn("__hay_of", hay), "__hay_of", dictionary_table(df.sparkSession, terms)).drop("__hay_of")
    if fuzzy:
        texts = rows.filter("txn_type = 'external_transfer' and __exact is null")
        scored = keep(fuzzy_terms(texts.select(F.explode(F.array("__recipient", "__text")).alias("t")), "t", similar_terms(terms)), "similar-terms")
        for field in ("__recipient", "__text"):
            rows = left_join_spread(rows, scored.select(F.col("t").alias(field), F.struct("category", "term", "score").alias(f"{field}_fuzzy")), field, "doc_id", "seq")
        first, second = F.col("__recipient_fuzzy"), F.col("__text_fuzzy")
        top = F.when(second.isNull() | (F.coalesce(first["score"], F.lit(-1.0)) >= second["score"]), first).otherwise(second)
        least = F.create_map(*[F.lit(x) for c, r in (terms or R.TRANSFER_TERMS).items() if r.get("fuzzy") for x in (c, float(r["fuzzy"]))], *([] if any(r.get("fuzzy") for r in (terms or R.TRANSFER_TERMS).values()) else [F.lit(""), F.lit(101.0)]))
        rows = rows.withColumn("__top", top).drop("__recipient_fuzzy", "__text_fuzzy")
        rows = rows.withColumn("__near", F.when(F.col("__top.score") >= F.try_element_at(least, F.col("__top.category")), F.col("__top"))).drop("__top")
    else:
        rows = rows.withColumn("__near", F.lit(None).cast("struct<category:string,term:string,score:double>"))
    confidence = F.coalesce("confidence", F.lit(0.0))
    known = F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv])
    areas = lambda category: F.coalesce(F.try_element_at(known, category), F.lit("Other"))
    near, exact = F.col("__near"), F.col("__exact")
    certainty = F.bround(F.least(F.lit(0.99), near["score"] / 100), 2)

    def evidence(state, kind, source, area, conf, remembered, term, score) -> Column:
        values = {"state": state, "evidence_type": kind, "match_source": source, "category_area": area, "confidence": conf, "remembered": remembered, "term": term, "score": score}
        types = {"confidence": "double", "remembered": "double", "score": "double"}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(types.get(k, "string")).alias(k) for k, v in values.items()])

    external = F.col("txn_type") == "external_transfer"
    own = (
        F.when(F.col("txn_type") == "salary_income", evidence("confirmed", "explicit_text", "bootstrap_exact", "Other", F.col("confidence"), F.greatest(confidence, F.lit(0.98)), F.lit(None), F.lit(None)))
        .when(external & exact.isNotNull(), evidence("confirmed", "exact_text", "bootstrap_exact", areas(exact["category"]), F.greatest(confidence, F.lit(0.97)), F.greatest(confidence, F.lit(0.97)), exact["term"], F.lit(100.0)))
        .when(external & near.isNotNull(), evidence(F.when(near["score"] >= 95, "confirmed").otherwise("candidate"), "fuzzy_text", "bootstrap_fuzzy", areas(near["category"]), F.greatest(confidence, certainty), F.greatest(confidence, certainty), near["term"], F.bround(near["score"], 2)))
        .when(external, evidence("unknown", "no_signal", "unknown", F.col("category_area"), F.col("confidence"), F.lit(None), F.lit(None), F.lit(None)))
    )
    return rows.withColumn("__own", own).drop("__exact", "__near")


def remember_first(df: DataFrame) -> DataFrame:
    """The memory rows that the confirming rows leave: the first of each entity, in order of doc_id and seq."""
    confirming = df.filter((F.col("__own.state") == "confirmed") & F.col("entity_key").isNotNull())
    name = F.coalesce("recipient_name", F.when(F.col("txn_type") == "salary_income", "salary_income").otherwise(F.col("__own.term")))
    month = month_key(F.col("booking_date"))
    record = F.struct("doc_id", "seq", name.alias("canonical_name"), F.col("__own.category_area").alias("category"), F.bround("__own.remembered", 4).alias("confidence"), F.col("__own.evidence_type").alias("evidence_type"), month.alias("month"))
    first = confirming.groupBy("entity_key").agg(F.min(record).alias("m"))
    return first.select("entity_key", F.col("m.doc_id").alias("first_doc"), F.col("m.seq").alias("first_row"), "m.canonical_name", "m.category", "m.confidence", F.lit("confirmed").alias("status"), F.col("m.month").alias("first_seen"), F.col("m.month").alias("last_seen"), F.lit(1).alias("months_seen"), "m.evidence_type")


def classify_transfers(df: DataFrame, memory: DataFrame | None = None, fuzzy: bool = True, terms: dict | None = None) -> DataFrame:
    """Sets state, evidence_type, match_source, category_area, confidence, fuzzy_match_term and fuzzy_match_score.

    df has the columns of a classified row, doc_id and seq. memory: rows of earlier runs (columns of MEMORY), of one profile;
    or of several with a column profile_id, which df has too. Of several rows of one entity the earliest counts.

    The evidence is written out, as it is both told and learned from.
    """
    rows = keep(own_evidence(counterparties(df), fuzzy, terms), "evidence")
    learned = remember_first(rows).select("entity_key", "first_doc", "first_row", F.struct("category", "confidence", "evidence_type").alias("__new"))
    rows = left_join_spread(rows, learned, "entity_key", "doc_id", "seq")
    if memory is not None:
        own = ["profile_id"] if "profile_id" in memory.columns and "profile_id" in df.columns else []
        first = F.min_by(F.struct("category", "confidence", "evidence_type", "status"), F.struct("first_seen", "last_seen", "category", "confidence", "evidence_type", "status"))
        known = memory.groupBy("entity_key", *own).agg(first.alias("__old"))
        if own:  # both parts of the key in one
            both = lambda: F.concat_ws("\u0001", "profile_id", "entity_key")
            rows = rows.withColumn("__entity", F.when(F.col("entity_key").isNotNull(), both()))
            rows = left_join_spread(rows, known.select(both().alias("__entity"), "__old"), "__entity", "doc_id", "seq").drop("__entity")
        else:
            rows = left_join_spread(rows, known, "entity_key", "doc_id", "seq")
    else:
        rows = rows.withColumn("__old", F.lit(None).cast("struct<category:string,confidence:double,evidence_type:string,status:string>"))
    active = F.col("txn_type").isin("external_transfer", "salary_income")
    after = (F.col("doc_id") > F.col("first_doc")) | ((F.col("doc_id") == F.col("first_doc")) & (F.col("seq") > F.col("first_row")))
    before = (F.col("doc_id") == F.col("first_doc")) & (F.col("seq") < F.col("first_row"))
    hit = F.when(F.col("__old").isNotNull(), F.struct("__old.category", "__old.confidence", "__old.evidence_type")).when(after, F.col("__new"))
    confidence = F.coalesce("confidence", F.lit(0.0))
    own = F.col("__own")
    back = active & hit.isNull() & before & own["state"].isin("candidate", "unknown")
    remembered = active & hit.isNotNull()
    internal = F.col("txn_type") == "internal_transfer"
    pick = lambda memory_value, back_value, own_value, other: F.when(remembered, memory_value).when(back, back_value).when(active, own_value).otherwise(other)
    old = lambda c, t="string": F.col(c) if c in df.columns else F.lit(None).cast(t)
    out = rows.withColumns(
        {
            "__state": F.when(internal, "excluded").otherwise(pick(F.lit("confirmed"), F.lit("confirmed"), own["state"], old("state"))),
            "__evidence": F.when(internal, "internal_transfer_filter").otherwise(pick(F.coalesce(hit["evidence_type"], F.lit("entity_memory")), F.lit("entity_memory_backfill"), own["evidence_type"], old("evidence_type"))),
            "__source": F.when(internal, "internal_transfer_filter").otherwise(pick(F.lit("entity_memory"), F.lit("entity_memory_backfill"), own["match_source"], old("match_source"))),
            "__area": pick(F.coalesce(hit["category"], F.col("category_area"), F.lit("Unknown")), F.coalesce(F.col("__new.category"), F.col("category_area"), F.lit("Unknown")), own["category_area"], F.col("category_area")),
            "__confidence": pick(F.greatest(confidence, F.coalesce(hit["confidence"], F.lit(0.95))), F.greatest(F.coalesce(own["confidence"], F.lit(0.0)), F.coalesce(F.col("__new.confidence"), F.lit(0.95))), own["confidence"], F.col("confidence")),
            "fuzzy_match_term": pick(F.lit(None).cast("string"), own["term"], own["term"], old("fuzzy_match_term")),
            "fuzzy_match_score": pick(F.lit(None).cast("double"), own["score"], own["score"], old("fuzzy_match_score", "double")),
        }
    )
    out = out.withColumns({"state": F.col("__state"), "evidence_type": F.col("__evidence"), "match_source": F.col("__source"), "category_area": F.col("__area"), "confidence": F.col("__confidence")})
    return out.drop("__state", "__evidence", "__source", "__area", "__confidence", "__own", "__old", "__new", "first_doc", "first_row", "__recipient", "__text")


def upsert_memory(memory: DataFrame, seen: DataFrame) -> DataFrame:
    """Memory after a month: first_seen stays, months_seen grows when the month is new.

    seen: entity_key, canonical_name, category, confidence, status, evidence_type, month (one row for each entity).
    """
    new = seen.select("entity_key", *[F.col(c).alias(f"n_{c}") for c in ("canonical_name", "category", "confidence", "status", "evidence_type", "month")])
    rows = memory.join(new, "entity_key", "full_outer")
    fresh = F.col("n_month").isNotNull()
    months = F.coalesce("months_seen", F.lit(0)) + F.when(fresh & ~F.col("last_seen").eqNullSafe(F.col("n_month")), 1).otherwise(0)
    pick = lambda c: F.coalesce(f"n_{c}", c).alias(c)
    return rows.select("entity_key", pick("canonical_name"), pick("category"), pick("confidence"), pick("status"), F.coalesce("first_seen", "n_month").alias("first_seen"), F.coalesce("n_month", "last_seen").alias("last_seen"), months.cast("int").alias("months_seen"), pick("evidence_type"))


