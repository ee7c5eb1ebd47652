"""Dashboard filters and drill-downs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walletscope.functions.labels import size_class
from walletscope.functions.scalars import instant
from walletscope.operators.joins import LIMITS, JoinLimits, join_by_key
from walletscope.params import MAX_LOOKBACK_DAYS
from walletscope.session import materialize

ALL = "All"
# Range of the return slider in percent.
MIN_RETURN_RANGE = (100.0, 50000.0)


def filter_positions(
    returns: DataFrame,
    launchpads: Sequence[str] = (),
    min_return_pct: float | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    min_invested: Decimal | None = None,
    size: str | None = None,
) -> DataFrame:
    """Positions matching every filter set; dates bound the first trade, both ends included."""
    if start and end and end - start > timedelta(days=MAX_LOOKBACK_DAYS):
        raise ValueError(f"date range exceeds {MAX_LOOKBACK_DAYS} days")
    if launchpads and ALL not in launchpads:
        returns = returns.where(F.col("launchpad_name").isin(*launchpads))
    if min_return_pct is not None:
        low, high = MIN_RETURN_RANGE
        if not low <= min_return_pct <= high:
            raise ValueError(f"min_return_pct must lie between {low} and {high}")
        returns = returns.where(F.col("return_pct") >= F.lit(float(min_return_pct)))
    if start is not None:
        returns = returns.where(F.col("first_trade") >= instant(start))
    if end is not None:
        returns = returns.where(F.col("first_trade") <= instant(end))
    if min_invested is not None:
        returns = returns.where(F.col("invested") >= F.lit(min_invested))
    if size is not None and size != ALL:
        returns = returns.where(size_class("invested") == size)
    return returns


def drill(returns: DataFrame, column: str, value: str) -> DataFrame:
    """All positions of one wallet, token or launchpad."""
    if column not in ("wallet", "token", "launchpad_name"):
        raise ValueError(f"cannot drill into {column!r}")
    return returns.where(F.col(column) == value)


def drill_among(rows: DataFrame, keys: DataFrame, columns: list[str], limits: JoinLimits = LIMITS) -> DataFrame:
    """Rows (positions or trades) whose key appears in another result, which is run once and stored."""
    stored = materialize(keys.select(*columns).distinct(), "drill-key")
    return join_by_key(rows, stored, columns, "left_semi", limits=limits)
