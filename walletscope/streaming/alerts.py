"""What changed with a batch: new moonshots, newly successful tokens, unusual activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.params import Params

TRAILING_HOURS = 24
SPIKE_FACTOR = 3.0
SPIKE_MIN_TRADES = 3


MOONSHOT, TOKEN = "moonshot", "token"


def above(crossings: DataFrame) -> DataFrame:
    """(kind, token, wallet) now above their threshold, by the last crossing of each. Tokens have the wallet NULL."""
    last = crossings.groupBy("kind", "token", "wallet").agg(F.max_by("above", "batch").alias("above"))
    return last.where("above").drop("above")


def _successful(shots: DataFrame, params: Params) -> DataFrame:
    traders = shots.groupBy("token").agg(F.count("*").alias("moonshot_traders"))
    return traders.where(F.col("moonshot_traders") >= params.min_moonshot_traders)


def _of_kind(before: DataFrame, kind: str, *keys: str) -> DataFrame:
    return before.where(F.col("kind") == kind).select(*keys)


def new_moonshots(shots: DataFrame, before: DataFrame) -> DataFrame:
    """Positions that reached the return threshold; ``before`` are those above it until now."""
    return shots.join(_of_kind(before, MOONSHOT, "token", "wallet"), ["token", "wallet"], "left_anti")


def new_successful_tokens(shots: DataFrame, before: DataFrame, params: Params) -> DataFrame:
    """Tokens that reached the required number of moonshot traders."""
    return _successful(shots, params).join(_of_kind(before, TOKEN, "token"), "token", "left_anti")


def crossings(shots: DataFrame, before: DataFrame, params: Params) -> DataFrame:
    """What went above a threshold or below it: all that has to be known of the past for the next alerts."""
    now = shots.select(F.lit(MOONSHOT).alias("kind"), "token", "wallet").unionByName(
        _successful(shots, params).select(F.lit(TOKEN).alias("kind"), "token", F.lit(None).cast("string").alias("wallet"))
    )
    both = now.select("*", F.lit(True).alias("above")).unionByName(before.select("*", F.lit(False).alias("above")))
    # What stands on one side only has crossed: up if it is now, down if it was.
    sides = both.groupBy("kind", "token", "wallet").agg(F.count("*").alias("sides"), F.bool_or("above").alias("above"))
    return sides.where("sides = 1").drop("sides")


def hourly_activity(trades: DataFrame) -> DataFrame:
    """(token, hour, trades). Hours are those of the time column, whatever the session's zone."""
    hour = F.date_trunc("hour", "block_time").cast("timestamp_ntz")
    return trades.groupBy("token", hour.alias("hour")).agg(F.count("*").alias("trades"))


def activity_spikes(
    activity: DataFrame,
    trailing_hours: int = TRAILING_HOURS,
    factor: float = SPIKE_FACTOR,
    min_trades: int = SPIKE_MIN_TRADES,
) -> DataFrame:
    """Hours in which a token traded far more than on average over the hours before.

    The window runs over one row per token and hour, so a token has at most as
    many rows as the history has hours, however much it traded.
    """
    number = _epoch_hour("hour")
    before = Window.partitionBy("token").orderBy(number).rangeBetween(-trailing_hours, -1)
    usual = F.coalesce(F.sum("trades").over(before), F.lit(0)) / F.lit(float(trailing_hours))
    return (
        activity.withColumn("usual_trades", usual)
        .where((F.col("trades") >= min_trades) & (F.col("usual_trades") > 0))
        .where(F.col("trades") > F.col("usual_trades") * F.lit(factor))
        .select("token", "hour", "trades", "usual_trades")
    )


def _epoch_hour(column: str) -> Column:
    """Hours since 1970."""
    since = F.col(column) - F.lit("1970-01-01").cast("timestamp_ntz")
    return since.cast("interval hour").cast("bigint")
