"""From statement pages to monthly rows and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import dedup as D
from ..operators import expenses as E
from ..operators import merchants as M
from ..operators import scoring as S
from ..operators import statements as P
from ..operators import transfers as T
from ..runtime import keep
from ..sources import sinks, tables


@dataclass
class Run:
    transactions: DataFrame
    removed: DataFrame
    features: DataFrame
    final: DataFrame
    quality: DataFrame
    kpis: DataFrame
    memory: DataFrame


@dataclass
class Rules:
    """A user's rules in place of the fixed ones: aliases and patterns of merchants, areas, and the dictionary of transfers."""

    aliases: dict[str, list[str]] | None = None
    patterns: list[tuple[str, str, int]] | None = None
    areas: dict | None = None
    terms: dict | None = None

    @classmethod
    def from_files(cls, aliases: str | None = None, areas: str | None = None, terms: str | None = None) -> Rules:
        """Rules of the files given (YAML, the dictionary JSON); a dictionary file that is absent or no object is no dictionary."""
        names, patterns = tables.alias_rules(tables.read_rules(aliases)) if aliases else (None, None)
        return cls(names, patterns, tables.category_rules(tables.read_rules(areas)) if areas else None, (tables.read_json_object(terms) or None) if terms else None)


def classify_rows(rows: DataFrame, firms: DataFrame | None = None, memory: DataFrame | None = None, external: DataFrame | None = None, fuzzy: bool = True, rules: Rules | None = None) -> DataFrame:
    """All columns of classified transactions, from the seven required ones with doc_id and seq."""
    spark, rules = rows.sparkSession, rules or Rules()
    # Written out: the merchants' spellings and the rows themselves are both read from it.
    rows = keep(C.extract_merchants(C.classify_types(rows)), "typed")
    patterns = spark.createDataFrame(rules.patterns, "pattern string, name string, priority int") if rules.patterns else None
    rows = M.normalise_merchants(rows, M.alias_table(spark, rules.aliases), firms, patterns, external, fuzzy)
    return C.row_flags(T.classify_transfers(C.map_categories(rows, rules.areas), memory, fuzzy, rules.terms))


def run_statements(pages: DataFrame, firms: DataFrame | None = None, memory: DataFrame | None = None, rules: Rules | None = None) -> Run:
    """A batch of statements: parsed, classified, without repeats, with monthly features."""
    rows = classify_rows(P.parse_statements(pages), firms, memory, rules=rules)
    # Order over all documents.
    rows = rows.withColumn("seq", F.struct("doc_id", "seq"))
    kept, removed = D.deduplicate(rows)
    kept = E.with_month(kept)
    features = E.feature_vector(E.expense_totals(kept, "statement_month"), "statement_month")
    income = E.salary_metrics(kept, "statement_month").select("statement_month", F.col("salary_income_total").alias("__income"))
    final = E.final_row(features.join(income, "statement_month"), "statement_month", income="__income")
    learned = T.remember_first(T.own_evidence(T.counterparties(rows.withColumn("seq", F.col("seq.seq"))), terms=rules.terms if rules else None)).drop("first_doc", "first_row")
    return Run(kept, removed, features, final, E.quality_metrics(kept), E.kpi_block(kept), learned)


def run_profile(pages: DataFrame, path: str, profile_id: str, firms: DataFrame | None = None, rules: Rules | None = None) -> Run:
    """A batch of one profile's statements with what earlier batches taught, which is kept for the next one.

    The table at path has the memory of all profiles; this profile's part is rewritten once the new one is known.
    """
    spark = pages.sparkSession
    # A copy: the run's tables are read from it when this profile's part is rewritten already.
    memory = keep(tables.load_memory(spark, path, profile_id, T.MEMORY), "memory-before")
    run = run_statements(pages, firms, memory, rules)
    seen = run.memory.withColumn("month", F.col("last_seen")).select("entity_key", "canonical_name", "category", "confidence", "status", "evidence_type", "month")
    sinks.save_memory(keep(T.upsert_memory(memory, seen), "memory"), path, profile_id)
    return run


def score_months(final: DataFrame, model: S.Model, keys: tuple[str, ...] = ("statement_month",)) -> DataFrame:
    """Predictions of final rows; a feature without a value counts as 0."""
    rows = final.select(*keys, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in model.columns])
    return S.predict(rows, model, *keys)
