"""Selections of canonical trades, per-token facts and launch-joined trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walletscope.functions.scalars import instant, whole_hours
from walletscope.operators.joins import LIMITS, JoinLimits, fits_broadcast, join_by_key
from walletscope.operators.ordered import numbered
from walletscope.params import Params
from walletscope.session import materialize
from walletscope.sources.tables import until, within

TRADE_ORDER = "decimal(38,0)"
_PLACES = "10000000000000000000"  # more than any position


def trade_order() -> Column:
    """One number that orders trades by time, then by position: microseconds, and 19 digits of position."""
    micros = (F.col("block_time") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(18,6)")
    micros = (micros * F.lit(1_000_000)).cast("decimal(18,0)")
    return (micros * F.lit(_PLACES).cast("decimal(20,0)") + F.col("position").cast("decimal(19,0)")).cast(TRADE_ORDER)


def newest() -> list[Column]:
    """State of the newest price: merges in any order, in a hash aggregate."""
    return [F.max(trade_order()).alias("newest"), F.max_by("price", trade_order()).alias("newest_price")]


def newest_merged() -> list[Column]:
    return [F.max("newest").alias("newest"), F.max_by("newest_price", "newest").alias("newest_price")]


def closing_price() -> Column:
    """Price of the newest trade; among trades at one instant of the last position. NULL when that has no price."""
    return F.max_by("price", trade_order())


def latest_price(trades: DataFrame) -> DataFrame:
    """(token, latest_price). The scope is whatever ``trades`` holds."""
    return trades.groupBy("token").agg(closing_price().alias("latest_price"))


def recent_tokens(trades: DataFrame, params: Params) -> DataFrame:
    """(token, first_seen, last_seen, latest_price) of tokens traded often enough in the window.

    A listed token traded inside the window, so its newest trade lies there
    too: the price needs no older rows.
    """
    return (
        within(trades, params)
        .groupBy("token")
        .agg(
            F.min("block_time").alias("first_seen"),
            F.max("block_time").alias("last_seen"),
            F.count("*").alias("_trades"),
            closing_price().alias("latest_price"),
        )
        .where(F.col("_trades") >= params.min_token_trades)
        .drop("_trades")
    )


def is_real_sided() -> Column:
    return F.coalesce((F.col("quantity_sign") > 0) & (F.col("amount_sign") > 0), F.lit(False))


def is_real_usd() -> Column:
    return F.coalesce((F.col("quantity_sign") != 0) & (F.col("amount_sign") > 0), F.lit(False))


def real_sided(trades: DataFrame) -> DataFrame:
    return trades.where(is_real_sided())


def real_normalized(trades: DataFrame, params: Params) -> DataFrame:
    return trades.where((F.col("quantity_sign") != 0) & (F.col("block_time") <= instant(params.as_of))).withColumn(
        "amount", F.abs("amount")
    )


class LaunchTable:
    """Launches written once, with the answer whether they may be broadcast.

    The check covers every table with one row per launched token as well.
    """

    def __init__(self, launches: DataFrame, limits: JoinLimits = LIMITS):
        self.rows = materialize(launches, "launches")
        self.small = fits_broadcast(self.rows, limits)
        self.limits = limits

    def attach(self, rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        """Join with a table of one row per launched token, or with the launches themselves."""
        return join_by_key(rows, table, ["token"], how, small=self.small, limits=self.limits)

    def trades_of(self, trades: DataFrame) -> DataFrame:
        """All trades of launched tokens, at any time."""
        return self.attach(trades, self.rows.select("token"), "left_semi")

    def trades_after(self, trades: DataFrame, *extra: str) -> DataFrame:
        """Trades from the launch of their token on (one launch per token)."""
        joined = self.attach(trades, self.rows.select("token", "launch_time", *extra))
        return joined.where(F.col("block_time") >= F.col("launch_time"))


def trades_normalized(trades: DataFrame, launches: LaunchTable, params: Params) -> DataFrame:
    """Trades of launched tokens with side, absolute amounts and their place in the wallet's sequence."""
    after = launches.trades_after(real_normalized(within(trades, params), params))
    keys = ["wallet", "token"]
    tie_break = ["tx_id", "side", "quantity", "amount", "price"]
    order = [F.col("block_time").asc(), *[F.col(c).asc_nulls_last() for c in tie_break]]
    result = numbered(after, keys, order, "trade_sequence")
    return result.select(
        F.col("token").alias("token_mint_address"),
        F.col("wallet").alias("trader_wallet"),
        "block_time",
        F.col("side").alias("instruction_name"),
        F.col("quantity").alias("token_amount"),
        F.col("amount").alias("sol_amount"),
        F.col("price").alias("price_per_token"),
        "tx_id",
        "trade_sequence",
    )


def token_traders(
    trades: DataFrame, launches: LaunchTable, params: Params, tokens: DataFrame | None = None
) -> DataFrame:
    """(token, all_traders): every wallet that traded a launched token up to ``as_of``.

    The history is the whole table. ``tokens`` (one row per token) narrows it.
    """
    past = until(trades, params)
    wanted = launches.trades_of(past) if tokens is None else launches.attach(past, tokens.select("token"), "left_semi")
    return wanted.groupBy("token").agg(F.countDistinct("wallet").alias("all_traders"))


def launchpad_volume(trades: DataFrame, launches: LaunchTable, params: Params) -> DataFrame:
    """Trading volume per launchpad, from launch on."""
    rows = real_sided(within(trades, params))
    # Sum per token first: the launchpad label then joins few rows.
    per_token = launches.trades_after(rows).groupBy("token").agg(
        F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(F.lit(0))).alias("_bought"),
        F.sum(F.when(F.col("side") == "sell", F.col("amount")).otherwise(F.lit(0))).alias("_sold"),
        F.sum("amount").alias("_volume"),
        F.count("*").alias("_trades"),
    )
    return (
        launches.attach(per_token, launches.rows.select("token", "launchpad_name"))
        .groupBy("launchpad_name")
        .agg(
            F.count("*").alias("tokens_traded"),
            F.sum("_trades").alias("trade_count"),
            F.sum("_bought").cast("double").alias("buy_volume"),
            F.sum("_sold").cast("double").alias("sell_volume"),
            F.sum("_volume").cast("double").alias("total_volume"),
        )
    )


def launch_to_first_trade(trades: DataFrame, launches: LaunchTable, params: Params) -> DataFrame:
    """Per launched token: hours until anyone traded it; NULL while nobody has."""
    rows = real_sided(within(trades, params))
    first = launches.trades_after(rows).groupBy("token").agg(F.min("block_time").alias("first_trade"))
    joined = launches.attach(launches.rows.select("launchpad_name", "token", "launch_time"), first, "left")
    return joined.select(
        "launchpad_name",
        F.col("token").alias("token_mint_address"),
        "launch_time",
        "first_trade",
        whole_hours("launch_time", "first_trade").alias("hours_to_first_trade"),
    )
