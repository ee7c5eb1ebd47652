"""Helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import walletscope
from walletscope.session import materialize


def vocabulary_file(name: str) -> str:
    """Where a public vocabulary file lies: in the installed package, or in the folder TOKENIZER_DIR names."""
    folder = os.environ.get("TOKENIZER_DIR")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


#: Rows of an Arrow batch. Texts differ in length a thousandfold, so batches are small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Settings that queries with Python parts need.

    Texts reach Python workers in batches of few rows, which bounds their memory.
    The package goes to the executors, once per application.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        spark.sparkContext.addPyFile(_package())
        _shipped.add(application)


_shipped: set[str] = set()


@lru_cache(maxsize=1)
def _package() -> str:
    root = Path(walletscope.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="walletscope-")) / "walletscope.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    return str(path)


#: Characters of text that tasks with work per batch take at a time.
BATCH_CHARS = 4_000_000


def by_size(batches: Iterator[pd.DataFrame], text_col: str, chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``chars`` characters; nulls must be gone."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(map(len, batch[text_col]))
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def checked_broadcast(df: DataFrame, values: int = 400_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``values`` (rows times columns of short values); runs it to count them."""
    return F.broadcast(df) if df.count() * len(df.columns) <= values else df


def without(
    docs: DataFrame, decide: Callable[[DataFrame, list[str]], DataFrame], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` but for those that ``decide`` returns.

    Rows are told apart by 128 bits of id and text, both of which may be null. ``decide``
    gets the rows and the names of these two columns, which its result must have.
    """
    keys = [free_name(docs, f"row_key_{seed}") for seed in (1, 2)]
    parts = [F.col(id_col), F.isnull(id_col), F.col(text_col), F.isnull(text_col)]
    marked = docs.withColumns({key: F.xxhash64(F.lit(seed), *parts) for seed, key in enumerate(keys)})
    dropped = materialize(decide(marked, keys).select(*keys).distinct(), "dropped-rows")
    return marked.join(checked_broadcast(dropped), keys, "left_anti").select(*docs.columns)
