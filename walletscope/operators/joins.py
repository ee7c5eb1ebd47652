"""Joins of a large, possibly skewed side with a table of facts per key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class JoinLimits:
    """When a table may be broadcast."""

    broadcast_bytes: int = 128 * 1024 * 1024


LIMITS = JoinLimits()


def payload_bytes(df: DataFrame) -> int:
    """Measured size of a table: text by its length, all else by a fixed width."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    fixed = 16 * (len(df.columns) - len(texts)) + 16 * len(texts) + 32
    length = sum((F.coalesce(F.octet_length(c).cast("bigint"), F.lit(0)) for c in texts), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(length + F.lit(fixed)), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limits: JoinLimits = LIMITS) -> bool:
    return payload_bytes(df) <= limits.broadcast_bytes


def join_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
    small: bool | None = None,
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """Join ``rows`` with ``table`` (inner, left or left_semi) on equal keys.

    ``small`` carries over a size check already made; ``None`` checks here, so
    pass a stored table. Only the side ``table`` is measured, ``rows`` is read
    once. A table beyond the limit is merge joined: it has one row per key, so
    adaptive execution splits a partition with a heavy key among tasks.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    if small is None:
        small = fits_broadcast(table, limits)
    # The hint keeps a table that was measured as large from being broadcast by an estimate.
    return rows.join(F.broadcast(table) if small else table.hint("merge"), keys, how)


def null_safe_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL. Columns of ``rows`` in their order, then the others of ``table``."""
    right = table.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return rows.join(right, same, how).drop(*[f"_right_{k}" for k in keys])
