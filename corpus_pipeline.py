"""A training-corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next one. All
but the last return the columns of documents; n_chars follows the text. The last adds token_ids (little-endian unsigned
32-bit integers), n_tokens and the digests of the ids and of the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from ledgerloom.llm.runtime import keep, shielded, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules accept."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows; a text that loses all its lines goes."""
    out = line_dedup.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, read back once."""
    docs = docs.drop("token_ids", "n_tokens", "ids_sha256", "decoded_sha256")
    safe, names = shielded(docs, "text")
    coded = bpe.encode_documents(safe)
    out = coded.select(*names, F.col("__bpe_ids").alias("token_ids"), *bpe.digests(coded))
    return out.toDF(*docs.columns, *out.columns[len(names) :])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_windows),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("bpe_encoding", token_ids),
]

#: Neither exact binomial tests nor byte-pair merges can be said in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
