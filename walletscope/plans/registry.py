"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame.

Results leave as plain numbers: DECIMAL columns, which are exact, as DOUBLE of
six digits, computed DOUBLE columns rounded to four.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walletscope.functions.scalars import round_dec
from walletscope.operators import filters, launches, returns, trades
from walletscope.plans import rollups
from walletscope.plans.flows import Flow, normalized_flow, sided_flow, usd_flow
from walletscope.session import configure, materialize, new_folder
from walletscope.sources import adapters as A
from walletscope.sources import schemas, sinks
from walletscope.sources.tables import count_rejects, sided_trades, signed_trades, until
from walletscope.streaming import alerts
from walletscope.streaming.jobs import CATCH_UP, ActivityJob, PositionJob, read_trade_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def published(df: DataFrame) -> DataFrame:
    digits = {T.DecimalType: 6, T.DoubleType: 4}
    return df.select(
        *[
            round_dec(f.name, digits[type(f.dataType)]).alias(f.name) if type(f.dataType) in digits else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return published(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return function


def usd(spark: SparkSession, sf_dir: str) -> Flow:
    return usd_flow(A.trades_signed(spark, sf_dir), A.USD_PARAMS)


def sided(spark: SparkSession, sf_dir: str, **changes) -> Flow:
    return sided_flow(
        A.activity_narrow(spark, sf_dir), A.trades_sided(spark, sf_dir), A.SIDED_PARAMS.with_(**changes)
    )


def normalized(spark: SparkSession, sf_dir: str, **changes) -> Flow:
    return normalized_flow(
        A.activity_wide(spark, sf_dir),
        A.instruction_calls(spark, sf_dir),
        A.trades_signed_compressed(spark, sf_dir),
        A.NORMALIZED_PARAMS.with_(**changes),
    )


def stored(flow: Flow) -> DataFrame:
    """Positions written once, for queries that read them more than once."""
    return materialize(flow.returns, "positions")


# --- launches, tokens, trades, prices --------------------------------------


@query
def launches_narrow(spark, sf_dir):
    return launches.launches_narrow(A.activity_narrow(spark, sf_dir), A.SIDED_PARAMS)


@query
def launches_narrow_event(spark, sf_dir):
    return launches.launches_narrow(A.activity_narrow(spark, sf_dir), A.SIDED_PARAMS.with_(launch_grain="event"))


def _wide(spark, sf_dir, grain):
    return launches.launches_wide(
        A.activity_wide(spark, sf_dir),
        A.instruction_calls(spark, sf_dir),
        A.NORMALIZED_PARAMS.with_(launch_grain=grain),
    )


@query
def launches_wide(spark, sf_dir):
    return _wide(spark, sf_dir, "token")


@query
def launches_wide_event(spark, sf_dir):
    return _wide(spark, sf_dir, "event")


@query
def recent_tokens(spark, sf_dir):
    tokens = trades.recent_tokens(signed_trades(A.trades_signed(spark, sf_dir)), A.USD_PARAMS)
    return tokens.select(F.col("token").alias("token_mint_address"), "first_seen", "last_seen")


@query
def trades_normalized(spark, sf_dir):
    table = trades.LaunchTable(_wide(spark, sf_dir, "token"))
    rows = signed_trades(A.trades_signed_compressed(spark, sf_dir))
    return trades.trades_normalized(rows, table, A.NORMALIZED_PARAMS)


@query
def trade_rejects(spark, sf_dir):
    """Raw trade values that do not fit their type, by column: what an ingest reports before it drops them."""
    return count_rejects(A.trades_signed(spark, sf_dir), schemas.TRADES_SIGNED)


@query
def latest_price_sided(spark, sf_dir):
    return trades.latest_price(until(sided_trades(A.trades_sided(spark, sf_dir)), A.SIDED_PARAMS))


@query
def latest_price_usd(spark, sf_dir):
    return trades.latest_price(until(signed_trades(A.trades_signed(spark, sf_dir)), A.USD_PARAMS))


@query
def latest_price_normalized(spark, sf_dir):
    table = trades.LaunchTable(_wide(spark, sf_dir, "token"))
    rows = trades.real_normalized(signed_trades(A.trades_signed_compressed(spark, sf_dir)), A.NORMALIZED_PARAMS)
    return trades.latest_price(table.trades_after(rows))


@query
def token_traders(spark, sf_dir):
    flow = sided(spark, sf_dir)
    return trades.token_traders(flow.trades, flow.launches, A.SIDED_PARAMS)


# --- positions, returns, moonshots -----------------------------------------


@query
def positions_usd(spark, sf_dir):
    return usd(spark, sf_dir).positions


@query
def positions_sided(spark, sf_dir):
    return sided(spark, sf_dir).positions


@query
def positions_sided_event(spark, sf_dir):
    return sided(spark, sf_dir, launch_grain="event").positions


@query
def positions_normalized(spark, sf_dir):
    return normalized(spark, sf_dir).positions


@query
def positions_normalized_event(spark, sf_dir):
    return normalized(spark, sf_dir, launch_grain="event").positions


@query
def position_returns_usd(spark, sf_dir):
    return usd(spark, sf_dir).returns


@query
def position_returns_sided(spark, sf_dir):
    return sided(spark, sf_dir).returns


@query
def position_returns_normalized(spark, sf_dir):
    return normalized(spark, sf_dir).returns


@query
def moonshots_sided(spark, sf_dir):
    return returns.moonshots_sided(sided(spark, sf_dir).returns, A.SIDED_PARAMS)


@query
def moonshots_main(spark, sf_dir):
    return returns.moonshots_main(normalized(spark, sf_dir).returns, A.NORMALIZED_PARAMS)


@query
def moonshots_usd(spark, sf_dir):
    return returns.moonshots_usd(usd(spark, sf_dir).returns, A.USD_PARAMS)


# --- roll-ups ---------------------------------------------------------------


@query
def wallet_moonshots(spark, sf_dir):
    return rollups.wallet_moonshots(sided(spark, sf_dir).returns, A.SIDED_PARAMS)


@query
def token_moonshots(spark, sf_dir):
    flow = sided(spark, sf_dir)
    return rollups.token_moonshots(flow.returns, flow.trades, flow.launches, A.SIDED_PARAMS)


@query
def repeat_winners(spark, sf_dir):
    return rollups.repeat_winners(usd(spark, sf_dir).returns, A.USD_PARAMS)


@query
def wallet_summary(spark, sf_dir):
    return rollups.wallet_summary(normalized(spark, sf_dir).returns, A.NORMALIZED_PARAMS)


@query
def wallet_win_rate(spark, sf_dir):
    """The wallet summary over losing positions too, which gives real win rates."""
    params = A.NORMALIZED_PARAMS.with_(base_min_return=float("-inf"))
    return rollups.wallet_summary(normalized(spark, sf_dir).returns, params)


@query
def launchpad_comparison(spark, sf_dir):
    return rollups.launchpad_comparison(stored(normalized(spark, sf_dir)))


@query
def token_success(spark, sf_dir):
    return rollups.token_success(normalized(spark, sf_dir).returns, A.NORMALIZED_PARAMS)


@query
def weekly_trends(spark, sf_dir):
    return rollups.weekly_trends(normalized(spark, sf_dir).returns, A.NORMALIZED_PARAMS)


@query
def trader_categories(spark, sf_dir):
    return rollups.trader_categories(normalized(spark, sf_dir).returns, A.NORMALIZED_PARAMS)


# --- dashboard --------------------------------------------------------------


@query
def category_by_tier(spark, sf_dir):
    return rollups.category_by_tier(normalized(spark, sf_dir).returns, A.NORMALIZED_PARAMS)


@query
def entry_window_stats(spark, sf_dir):
    return rollups.entry_window_stats(normalized(spark, sf_dir).returns)


@query
def hold_window_stats(spark, sf_dir):
    return rollups.hold_window_stats(normalized(spark, sf_dir).returns)


@query
def launch_frequency(spark, sf_dir):
    return launches.launch_frequency(_wide(spark, sf_dir, "token"))


@query
def launchpad_volume(spark, sf_dir):
    flow = sided(spark, sf_dir)
    return trades.launchpad_volume(flow.trades, flow.launches, A.SIDED_PARAMS)


@query
def launch_to_first_trade(spark, sf_dir):
    flow = sided(spark, sf_dir)
    return trades.launch_to_first_trade(flow.trades, flow.launches, A.SIDED_PARAMS)


@query
def top_wallets(spark, sf_dir):
    return rollups.top_wallets(normalized(spark, sf_dir).returns, A.NORMALIZED_PARAMS)


@query
def filter_positions(spark, sf_dir):
    return filters.filter_positions(
        normalized(spark, sf_dir).returns,
        launchpads=("pump.fun", "bags"),
        min_return_pct=500.0,
        start=datetime(2024, 1, 20),
        end=datetime(2024, 4, 1),
        min_invested=Decimal("0.1"),
        size="Big Fish (10-100 SOL)",
    )


@query
def drill_wallet(spark, sf_dir):
    """All positions of the wallet with the highest total profit on a launchpad."""
    rows = stored(normalized(spark, sf_dir))
    best = rollups.top_wallets(rows, A.NORMALIZED_PARAMS, rows=1)
    return filters.drill_among(rows, best.withColumnRenamed("trader_wallet", "wallet"), ["wallet"])


@query
def drill_token(spark, sf_dir):
    """All trades of the token with the most traders above 1000 %."""
    flow = normalized(spark, sf_dir)
    best = rollups.token_success(flow.returns, A.NORMALIZED_PARAMS).limit(1)
    key = best.select(F.col("token_mint_address").alias("token"))
    past = until(flow.trades, A.NORMALIZED_PARAMS)
    found = filters.drill_among(past, key, ["token"])
    return found.select("token", "wallet", "side", "quantity", "amount", "price", "tx_id", "block_time")


@query
def drill_launchpad(spark, sf_dir):
    """All positions on the launchpad with the highest moonshot rate."""
    rows = stored(normalized(spark, sf_dir))
    best = rollups.launchpad_comparison(rows).where("moonshot_rate_rank = 1")
    return filters.drill_among(rows, best, ["launchpad_name"])


@query
def export_csv(spark, sf_dir):
    """The wallet list written as CSV and read back."""
    wallets = rollups.wallet_summary(normalized(spark, sf_dir).returns, A.NORMALIZED_PARAMS)
    listing = wallets.select("trader_wallet", "launchpad_name", "total_profit_sol", "moonshot_count", "profit_rank")
    path = new_folder(spark, "wallet-list")
    sinks.export_csv(listing, path)
    return spark.read.schema(listing.schema).csv(path, header=True)


# --- incremental ------------------------------------------------------------


def _run_deliveries(spark: SparkSession, sf_dir: str, job, root: str) -> None:
    """Deliver the trades in periods of ten days and let the job catch up after each."""
    number = F.coalesce(F.floor(F.datediff("block_time", F.lit("2024-01-01").cast("date")) / 10), F.lit(0))
    rows = A.trades_from_events(spark, sf_dir).withColumn("delivery", F.greatest(number, F.lit(0)))
    last = rows.agg(F.max("delivery")).first()[0]
    for delivery in range((last if last is not None else -1) + 1):
        part = rows.where(F.col("delivery") == delivery).drop("delivery")
        part.write.mode("append").parquet(f"{root}/inbox")
        job.start(read_trade_stream(spark, f"{root}/inbox"), CATCH_UP).awaitTermination()


def _position_job(spark: SparkSession, sf_dir: str) -> PositionJob:
    root = new_folder(spark, "stream")
    job = PositionJob(spark, f"{root}/state", A.EVENT_PARAMS)
    _run_deliveries(spark, sf_dir, job, root)
    return job


@query
def stream_positions(spark, sf_dir):
    """Positions kept by the incremental job over several deliveries."""
    return _position_job(spark, sf_dir).returns()


@query
def stream_alerts(spark, sf_dir):
    """New moonshots and newly successful tokens, with the delivery that made them so."""
    job = _position_job(spark, sf_dir)
    wallets = job.alerts("moonshot_alerts").select(
        F.lit("moonshot").alias("kind"), "token", "wallet", "return_pct", F.lit(1).cast("bigint").alias("traders"), "batch"
    )
    tokens = job.alerts("token_alerts").select(
        F.lit("token").alias("kind"),
        "token",
        F.lit(None).cast("string").alias("wallet"),
        F.lit(None).cast("double").alias("return_pct"),
        F.col("moonshot_traders").alias("traders"),
        "batch",
    )
    return wallets.unionByName(tokens)


@query
def activity_spikes(spark, sf_dir):
    """Hours of unusual trading over the whole history."""
    return alerts.activity_spikes(alerts.hourly_activity(signed_trades(A.trades_from_events(spark, sf_dir))))


@query
def stream_spikes(spark, sf_dir):
    """The same kept up to date by deliveries, late trades included."""
    root = new_folder(spark, "stream")
    job = ActivityJob(spark, f"{root}/state")
    _run_deliveries(spark, sf_dir, job, root)
    return job.spikes()
