"""The three ways from raw tables to evaluated positions.

Building a flow stores its launches. Positions are built when they are first asked
for, which stores one row per wallet and token; queries that need trades and
launches only never pay for them. In production store the returns once with
``sources.sinks.write_positions`` and run the roll-ups on the stored table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from walletscope.operators import positions as P
from walletscope.operators.joins import LIMITS, JoinLimits
from walletscope.operators.launches import launches_narrow, launches_wide
from walletscope.operators.returns import normalized_returns, with_returns
from walletscope.operators.trades import LaunchTable
from walletscope.params import NORMALIZED, SIDED, USD, Params
from walletscope.sources.tables import sided_trades, signed_trades


class Flow:
    """Trades, launches, and what follows from them."""

    def __init__(
        self,
        trades: DataFrame,
        launches: LaunchTable | None,
        build: Callable[[], DataFrame],
        evaluate: Callable[[DataFrame], DataFrame] = with_returns,
    ):
        self.trades, self.launches = trades, launches
        self._build, self._evaluate = build, evaluate

    @cached_property
    def positions(self) -> DataFrame:
        return self._build()

    @cached_property
    def returns(self) -> DataFrame:
        return self._evaluate(self.positions)


def usd_flow(raw_trades: DataFrame, params: Params = USD, limits: JoinLimits = LIMITS) -> Flow:
    """Signed trades only: a token's first trade in the window stands for its launch."""
    trades = signed_trades(raw_trades)
    return Flow(trades, None, lambda: P.positions_usd(trades, params, limits))


def sided_flow(
    activity: DataFrame, raw_trades: DataFrame, params: Params = SIDED, limits: JoinLimits = LIMITS
) -> Flow:
    """Narrow launch activity and trades that name their side."""
    launches = LaunchTable(launches_narrow(activity, params), limits)
    trades = sided_trades(raw_trades)
    return Flow(trades, launches, lambda: P.positions_sided(trades, launches, params))


def normalized_flow(
    activity: DataFrame,
    calls: DataFrame,
    raw_trades: DataFrame,
    params: Params = NORMALIZED,
    limits: JoinLimits = LIMITS,
) -> Flow:
    """Wide launch activity, instruction calls and signed trades."""
    launches = LaunchTable(launches_wide(activity, calls, params), limits)
    trades = signed_trades(raw_trades)
    return Flow(
        trades,
        launches,
        lambda: P.positions_normalized(trades, launches, params),
        lambda positions: normalized_returns(positions, params),
    )
