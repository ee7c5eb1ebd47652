"""Profit, return and timing of positions, and the three result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walletscope.functions import labels as L
from walletscope.functions.scalars import account_link, round_dec, token_link, whole_hours
from walletscope.params import Params


def with_returns(positions: DataFrame) -> DataFrame:
    """Add realized, unrealized, total_pnl, return_pct, entry_hours and hold_hours.

    A negative balance (more sold than bought in the window) counts negatively.
    """
    invested = F.col("invested").cast("double")
    realized = (F.col("received") - F.col("invested")).cast("double")
    unrealized = F.col("balance").cast("double") * F.coalesce("latest_price", F.lit(0.0))
    valued = positions.withColumns({"realized": realized, "unrealized": unrealized})
    return valued.withColumn("total_pnl", F.col("realized") + F.col("unrealized")).withColumns(
        {
            "return_pct": F.when(invested > 0, F.col("total_pnl") / invested * F.lit(100.0)).otherwise(F.lit(0.0)),
            "entry_hours": whole_hours("launch_time", "first_trade"),
            "hold_hours": whole_hours("first_trade", "last_trade"),
        }
    )


def normalized_returns(positions: DataFrame, params: Params) -> DataFrame:
    """Returns of launch-joined positions of at least the minimum investment."""
    return with_returns(positions.where(F.col("invested") >= F.lit(params.min_invested)))


def moonshots(returns: DataFrame, params: Params) -> DataFrame:
    return returns.where(F.col("return_pct") >= F.lit(params.min_return_pct))


def _double(name: str, alias: str) -> Column:
    return F.col(name).cast("double").alias(alias)


def _multiple() -> Column:
    return round_dec(F.col("return_pct") / 100, 1).alias("profit_multiple")


def moonshots_sided(returns: DataFrame, params: Params) -> DataFrame:
    """Best positions of the sided variant, best return first."""
    profit = round_dec("total_pnl", 4)
    best = (
        moonshots(returns, params)
        .orderBy(F.col("return_pct").desc(), profit.desc(), "token", "wallet", "launch_time", "launchpad_name")
        .limit(params.row_limit)
    )
    return best.select(
        "launchpad_name",
        F.col("wallet").alias("trader_wallet"),
        F.col("token").alias("token_mint_address"),
        round_dec("invested", 4).alias("sol_invested"),
        round_dec("received", 4).alias("sol_received"),
        round_dec("balance", 2).alias("tokens_remaining"),
        profit.alias("profit_sol"),
        round_dec("return_pct", 2).alias("return_percentage"),
        "trade_count",
        _double("hold_hours", "hold_hours"),
        _double("entry_hours", "hours_after_launch"),
        "launch_time",
        "first_trade",
        "last_trade",
        L.return_tier("return_pct").alias("moonshot_category"),
        _multiple(),
        L.entry_timing("entry_hours").alias("entry_timing"),
        L.hold_strategy("hold_hours").alias("hold_strategy"),
    )


def moonshots_main(returns: DataFrame, params: Params) -> DataFrame:
    """Best positions of the launch-joined variant. Amounts keep their historic ``sol`` names."""
    best = (
        moonshots(returns, params)
        .orderBy(F.col("return_pct").desc(), F.col("total_pnl").desc(), "token", "wallet", "launch_time", "launchpad_name")
        .limit(params.row_limit)
    )
    return best.select(
        "launchpad_name",
        F.col("wallet").alias("trader_wallet"),
        F.col("token").alias("token_mint_address"),
        _double("invested", "total_sol_invested"),
        _double("received", "total_sol_received"),
        _double("balance", "current_token_balance"),
        F.col("total_pnl").alias("total_pnl_sol"),
        round_dec("return_pct", 2).alias("return_pct"),
        F.col("trade_count").alias("total_trades"),
        _double("hold_hours", "duration_hours"),
        F.col("first_trade").alias("first_trade_time"),
        F.col("last_trade").alias("last_trade_time"),
        "launch_time",
        L.return_band("return_pct").alias("moonshot_tier"),
        F.col("entry_hours").alias("hours_after_launch"),
        account_link("wallet").alias("wallet_link"),
        token_link("token").alias("token_link"),
    )


def moonshots_usd(returns: DataFrame, params: Params) -> DataFrame:
    """Best positions of the launch-less variant."""
    profit = round_dec("total_pnl", 2)
    best = (
        moonshots(returns, params)
        .orderBy(F.col("return_pct").desc(), profit.desc(), "token", "wallet")
        .limit(params.row_limit)
    )
    return best.select(
        F.col("wallet").alias("trader_wallet"),
        F.col("token").alias("token_mint_address"),
        round_dec("invested", 2).alias("invested_usd"),
        round_dec("received", 2).alias("received_usd"),
        profit.alias("profit_usd"),
        round_dec("return_pct", 2).alias("return_pct"),
        round_dec("balance", 0).alias("tokens_remaining"),
        round_dec("unrealized", 2).alias("unrealized_value_usd"),
        F.col("trade_count").alias("total_trades"),
        _double("entry_hours", "hours_after_launch"),
        _double("hold_hours", "hold_hours"),
        "launch_time",
        F.col("first_trade").alias("first_trade_time"),
        F.col("last_trade").alias("last_trade_time"),
        L.return_tier("return_pct").alias("moonshot_tier"),
        _multiple(),
        L.entry_timing("entry_hours").alias("entry_timing"),
        L.hold_strategy("hold_hours").alias("hold_strategy"),
        account_link("wallet").alias("wallet_link"),
        token_link("token").alias("token_link"),
    )
