"""Exact dedup: groups by a 128-bit content hash, checked by comparing bytes.

The group aggregate carries the smallest and the largest text of each hash
beside the id that stays. Where both are the same bytes, all texts of the hash
are. A hash shared by different texts (a collision) has its rows grouped again,
by the texts themselves. No group is gathered: every aggregate combines before
its shuffle.

Null texts count as empty. Texts are compared as they are. Of equal texts the
row with the largest id stays (``keep="last"``) or the one with the smallest
(``keep="first"``); a null id stays only if the group has no other. Rows that
repeat the id that stays are the same document and all stay. An empty table
gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walletscope.llm.common import free_name
from walletscope.session import materialize

HASH: Callable[[Column], Column] = F.md5


def duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "last",
    columns: Sequence[str] | None = None,
    content_hash: Callable[[Column], Column] = HASH,
) -> DataFrame:
    """The rows of ``docs`` with ``columns`` (all by default), and keep_id, group_size, kept.

    Columns of these three names are replaced. The groups are written once; texts
    move with the aggregate, and again only if ``columns`` names them.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    wanted = [c for c in (columns or docs.columns) if c in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark, exact = free_name(docs, "content"), free_name(docs, "exact")
    best = F.max(id_col) if keep == "last" else F.min(id_col)
    hashed = docs.withColumn(mark, content_hash(text))
    groups = materialize(
        hashed.groupBy(mark).agg(
            best.alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            (F.min(text) == F.max(text)).alias("one_text"),
        ),
        "content-groups",
    )

    def finished(rows: DataFrame) -> DataFrame:
        kept = F.col(id_col).eqNullSafe(F.col("keep_id"))
        return rows.withColumn("kept", kept).select(*wanted, "keep_id", "group_size", "kept")

    lean = hashed.select(*dict.fromkeys([*wanted, id_col, mark]))
    result = finished(lean.join(groups.where("one_text").drop("one_text"), mark))
    if groups.where("NOT one_text").isEmpty():
        return result
    # Different texts under one hash: grouped by the texts themselves.
    mixed = hashed.join(groups.where("NOT one_text").select(mark), mark, "left_semi").withColumn(exact, text)
    by_text = mixed.groupBy(exact).agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return result.unionByName(finished(mixed.join(by_text, exact)))


def op2_exact_dedup(docs: DataFrame) -> DataFrame:
    lean = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
    return duplicates(lean, columns=["doc_id", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
