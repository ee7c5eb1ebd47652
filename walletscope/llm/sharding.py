"""Sharding by rendezvous hashing over weighted shards.

Shard ``s`` of weight ``w`` draws ``u`` in (0, 1) from a hash of the record key and
``s``, and scores ``-w / ln(u)``; the highest score wins. A record's draws don't
depend on the number of shards, so one more shard takes records only into
itself, about its share by weight. Key and shards alone decide: equal texts
under different keys may part.

Rows are numbered in each shard without a gap. They are dealt into slices by a
hash of a number of their own, numbered in each slice, and moved up by the counts of
the slices before; a slice has a bounded expected size, whatever a shard holds and
however many rows share a key.

Null keys count as one key. Rows of equal keys share the shard and have slots of
their own. Null texts have size 8 and the checksum of the empty text. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.llm.common import free_name
from walletscope.session import materialize

SHARDS = 24
ROWS_A_SLICE = 500
MAX_SLICES = 20_000  # beyond ten million rows slices get longer; results don't change


def score(key: Column, shard: int, weight: float) -> Column:
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return F.lit(-float(weight)) / F.log((draw.cast("double") + 0.5) * F.lit(2.0**-53))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard of the highest score; the lowest number among equal scores."""
    scores = [F.struct(score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    return -(F.greatest(*scores)["shard"] if len(scores) > 1 else scores[0]["shard"])


def numbered(df: DataFrame, group: str, key: str, slot: str = "slot") -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... in each ``group``, in order of slices and keys. Reads ``df`` twice."""
    slices = max(1, min(MAX_SLICES, -(-df.count() // ROWS_A_SLICE)))
    part, first = free_name(df, "slice"), free_name(df, "first_slot")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(F.col(key), F.lit("slice")), F.lit(slices)))
    counts = dealt.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    others = [c for c in df.columns if c not in (key, group)]
    within = Window.partitionBy(group, part).orderBy(key, *others)
    return (
        dealt.withColumn(slot, F.row_number().over(within) - 1)
        .join(starts, [group, part])
        .select(*df.columns, (F.col(first) + F.col(slot)).cast("bigint").alias(slot))
    )


def sharded(df: DataFrame, key: str, weights: Sequence[float] = (1.0,) * SHARDS, more: float | None = None) -> DataFrame:
    """Adds ``shard``, and ``grown_shard``: the shard if there were one more, of weight ``more`` (null without it)."""
    grown = shard_of(F.col(key), [*weights, more]) if more is not None else F.lit(None)
    return df.withColumns({"shard": shard_of(F.col(key), weights).cast("int"), "grown_shard": grown.cast("int")})


def op8_sharding(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lean = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
    )
    # Numbered by a number of the row's own: many rows may share an id, or have none.
    placed = materialize(sharded(lean, "doc_id", more=1.0).withColumn("row", F.monotonically_increasing_id()), "sharded")
    return numbered(placed, "shard", "row").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
