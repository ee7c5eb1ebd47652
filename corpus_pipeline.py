"""A corpus pipeline over ``documents``: languages, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but
the last return the columns of ``docs``. Extra columns pass through; null and
empty texts, null and repeated ids, and empty tables follow the operators' rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletscope.llm import exact_dedup, language, near_dups, packing, secret_scan
from walletscope.llm.common import checked_broadcast, free_name, prepare, table, without
from walletscope.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose text is in no known language; those without a word of letters follow their source."""
    prepare(spark)
    return without(docs, lambda rows, keys: language.of_documents(rows, keys).where("NOT kept"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return without(docs, lambda rows, keys: exact_dedup.duplicates(rows, columns=keys).where("NOT kept"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the row with the smallest id.

    Different texts under one id are documents of their own here, after all others of their class.
    """
    prepare(spark)

    def near(rows: DataFrame, keys: list[str]) -> DataFrame:
        own, again = free_name(rows, "own_id"), free_name(rows, "again")
        several = rows.groupBy("doc_id").agg((F.min(keys[0]) < F.max(keys[0])).alias(again)).where(again)
        several = checked_broadcast(materialize(several.where("doc_id IS NOT NULL"), "repeated-ids"))
        hashed = F.shiftrightunsigned(keys[0], 2).bitwiseOR(F.lit(1 << 62))
        marked = rows.join(several, "doc_id", "left").withColumn(own, F.when(F.col(again), hashed).otherwise(F.col("doc_id")))
        return near_dups.near_duplicates(marked, own, keep=keys).where("NOT kept")

    return without(docs, near)


def free_of_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret, and n_chars of the new text."""
    prepare(spark)
    clean = secret_scan.without_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    same = F.col("n_chars").isNull() & F.col("text").isNull()
    size = F.when(same, F.col("n_chars")).otherwise(F.char_length(F.coalesce("text", F.lit(""))).cast("bigint"))
    return clean.withColumn("n_chars", size)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents left, cut and packed into windows."""
    prepare(spark)
    return packing.op9_packing(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", distinct_texts),
    ("MinHash near-dedup", distinct_documents),
    ("secret scans", free_of_secrets),
    ("packing", packed),
]
#: No SQL: the stages compute models, sketches and tokens. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
