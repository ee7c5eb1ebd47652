"""Daily partial results per (token, wallet), which the stream keeps as state and positions are made of.

The history window starts at a midnight, so daily partials are exact at its edge,
although the first trade in the window moves as the window slides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walletscope.operators.joins import LIMITS, JoinLimits, join_by_key
from walletscope.operators.positions import COLUMNS, SUMS, book
from walletscope.operators.trades import is_real_usd, newest, newest_merged
from walletscope.params import Params
from walletscope.session import materialize

KEYS = ("token", "wallet", "trade_date")
SCHEMA = (
    "token string, wallet string, trade_date date, "
    + ", ".join(f"{c} decimal(38,9)" for c in SUMS)
    + ", first_trade timestamp_ntz, last_trade timestamp_ntz, trade_count bigint, all_trades bigint"
    + ", first_seen timestamp_ntz, last_seen timestamp_ntz, newest decimal(38,0), newest_price double"
)
VALUES = tuple(c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in KEYS)
_IDENTITY = ("tx_id", "token", "wallet", "side", "quantity", "amount", "block_time", "position")


def instant_of(column: str) -> Column:
    """A time without zone as the instant it is in UTC, whatever the session's zone: watermarks need instants."""
    seconds = (F.col(column) - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(18,6)")
    return F.timestamp_micros((seconds * F.lit(1_000_000)).cast("bigint"))


def identity() -> list[Column]:
    """128 bits that tell trades apart. The position does so for equal fills of one transaction."""
    known = [F.isnotnull(c) for c in _IDENTITY]
    return [F.xxhash64(F.lit(seed), *_IDENTITY, *known).alias(f"id_{seed}") for seed in (1, 2)]


def daily_partials(trades: DataFrame, instant: str) -> DataFrame:
    """Partials of canonical trades by UTC day of ``instant``, as a streaming or batch aggregate.

    Trades without amount or quantity stay out of the sums, yet count for
    when a token was first seen, how often it traded and its newest price.
    """
    grouped = trades.groupBy(F.window(instant, "1 day").alias("day"), "token", "wallet").agg(
        *book(is_real_usd()),
        F.count("*").alias("all_trades"),
        F.min("block_time").alias("first_seen"),
        F.max("block_time").alias("last_seen"),
        *newest(),
    )
    day = F.date_from_unix_date((F.unix_seconds("day.start") / 86_400).cast("int"))
    return grouped.select("token", "wallet", day.alias("trade_date"), *[F.col(c).cast(t).alias(c) for c, t in _types()])


def _types() -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in SCHEMA.split(", ") if c.split()[0] in VALUES]


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each key in a table of changed partials, one row for every batch that changed it."""
    return changes.groupBy(*KEYS).agg(*[F.max_by(c, "batch").alias(c) for c in VALUES])


def positions_from_partials(partials: DataFrame, params: Params, limits: JoinLimits = LIMITS) -> DataFrame:
    """The launch-less positions, equal to ``positions_usd`` over the same trades."""
    inside = partials.where(F.col("trade_date") >= F.lit(params.window_start.date()))
    held = materialize(
        inside.groupBy("token", "wallet").agg(
            *[F.sum(c).cast("decimal(38,9)").alias(c) for c in SUMS],
            F.min("first_trade").alias("first_trade"),
            F.max("last_trade").alias("last_trade"),
            F.sum("trade_count").alias("trade_count"),
            F.sum("all_trades").alias("all_trades"),
            F.min("first_seen").alias("first_seen"),
            *newest_merged(),
        ),
        "wallet-partials",
    )
    tokens = (
        held.groupBy("token")
        .agg(F.min("first_seen").alias("launch_time"), F.sum("all_trades").alias("_trades"), *newest_merged())
        .where(F.col("_trades") >= params.min_token_trades)
        .select("token", "launch_time", F.col("newest_price").alias("latest_price"))
    )
    enough = (F.col("trade_count") > 0) & (F.col("invested") >= F.lit(params.min_invested))
    rows = held.where(enough).drop("all_trades", "first_seen", "newest", "newest_price")
    joined = join_by_key(rows, materialize(tokens, "recent-tokens"), ["token"], limits=limits)
    return joined.withColumn("launchpad_name", F.lit(None).cast("string")).select(*COLUMNS)
