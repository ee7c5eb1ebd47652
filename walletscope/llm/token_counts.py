"""Token counts by rank-synchronous array merging (see ``byte_bpe``).

Special strings inside texts count as one token each, as the library takes them
by default. Null and empty texts have 0 tokens and 0 bytes. Whole texts are
counted; one row per input row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from walletscope.llm import byte_bpe
from walletscope.llm.characters import characters
from walletscope.llm.common import vocabulary_file

VOCABULARY = vocabulary_file("byte_bpe_50k.json")
LIMIT = 1024


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    classes = characters()

    @pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(byte_bpe.load(vocabulary, classes).count_batch(texts.tolist()), dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def op5_token_counts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        token_count(F.col("text")).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > LIMIT)
