"""The operators as registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from walletscope.llm import collocations, exact_dedup, fingerprints, hard_negatives, html_text, katz, language, near_dups, packing, secret_scan, sharding, token_counts, word_bpe
from walletscope.llm.common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return operator(table(spark, sf_dir, name))

    return run


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language.of_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": _over("documents", fingerprints.op1_fingerprints),
    "op2_exact_dedup": _over("documents", exact_dedup.op2_exact_dedup),
    "op3_secret_scan": _over("documents", secret_scan.op3_secret_scan),
    "op4_language_id": _over("documents", language.op4_language_id),
    "op5_token_counts": _over("documents", token_counts.op5_token_counts),
    "op6_html_text": _over("pages", html_text.op6_html_text),
    "op7_word_bpe": _over("documents", word_bpe.op7_word_bpe),
    "op8_sharding": _over("documents", sharding.op8_sharding),
    "op9_packing": _over("documents", packing.op9_packing),
    "op10_near_dups": _over("documents", near_dups.op10_near_dups),
    "op11_hard_negatives": _over("embeddings", hard_negatives.op11_hard_negatives),
    "op12_collocations": _over("documents", collocations.op12_collocations),
    "op13_katz": _over("documents", katz.op13_katz),
    "pages_language": pages_language,
}

ORACLE: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
