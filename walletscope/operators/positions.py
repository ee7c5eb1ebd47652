"""Positions: what one wallet put into, took out of and still holds of one token.

Canonical columns: launchpad_name, token, launch_time, wallet, invested,
tokens_bought, received, tokens_sold, balance, first_trade, last_trade,
trade_count, latest_price.

The trades are read and shuffled once: combined by (token, wallet), with the
state of the newest price beside the sums, and stored. Token
prices, token facts and positions all come from the stored table, which has a
row per wallet and token. Rows that don't trade (zero amounts, or from before
the launch) may still quote a price; they stay out of the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.functions.scalars import AMOUNT
from walletscope.operators import trades as T
from walletscope.operators.joins import LIMITS, JoinLimits, join_by_key
from walletscope.operators.trades import LaunchTable
from walletscope.params import Params
from walletscope.session import materialize
from walletscope.sources.tables import within

COLUMNS = (
    "launchpad_name",
    "token",
    "launch_time",
    "wallet",
    "invested",
    "tokens_bought",
    "received",
    "tokens_sold",
    "balance",
    "first_trade",
    "last_trade",
    "trade_count",
    "latest_price",
)
SUMS = ("invested", "tokens_bought", "received", "tokens_sold", "balance")


def _sum_when(counted: Column, *cases: tuple[str, Column]) -> Column:
    """Sum over counted rows of the value given for the row's side; other sides add 0."""
    value = zero = F.lit(0).cast(AMOUNT)
    for side, amount in cases:
        value = F.when(F.col("side") == side, amount).otherwise(value)
    return F.sum(F.when(counted, value).otherwise(zero))


def book(counted: Column) -> list[Column]:
    """Aggregates of a group of trades over the counted ones; every one merges from partial results."""
    amount, quantity = F.col("amount"), F.col("quantity")
    moment = F.when(counted, F.col("block_time"))
    return [
        _sum_when(counted, ("buy", amount)).alias("invested"),
        _sum_when(counted, ("buy", quantity)).alias("tokens_bought"),
        _sum_when(counted, ("sell", amount)).alias("received"),
        _sum_when(counted, ("sell", quantity)).alias("tokens_sold"),
        _sum_when(counted, ("buy", quantity), ("sell", -quantity)).alias("balance"),
        F.min(moment).alias("first_trade"),
        F.max(moment).alias("last_trade"),
        F.count_if(counted).alias("trade_count"),
    ]


def token_prices(partials: DataFrame) -> DataFrame:
    """(token, latest_price) from stored partials."""
    priced = partials.groupBy("token").agg(*T.newest_merged())
    return priced.select("token", F.col("newest_price").alias("latest_price"))


def _enough(params: Params) -> Column:
    return (F.col("trade_count") > 0) & (F.col("invested") >= F.lit(params.min_invested))


def _only_held(partials: DataFrame, enough: Column) -> DataFrame:
    """Sums and times of partials that make no position, which nobody reads, become NULL before they are stored."""
    marked = partials.withColumn("_held", enough)
    unread = [c for c in (*SUMS, "first_trade", "last_trade", "trade_count") if c in partials.columns]
    return marked.withColumns({c: F.when(F.col("_held"), F.col(c)) for c in unread}).drop("_held")


def positions_usd(trades: DataFrame, params: Params, limits: JoinLimits = LIMITS) -> DataFrame:
    """Positions without launch data: a token starts with its first trade in the window.

    Trades are dealt by (token, wallet) before they are combined. Most wallets trade a token
    once or twice, so combining first saved hardly a row, and its states, wider than the
    trades, were spilled and shuffled.
    """
    needed = ("token", "wallet", "side", "quantity", "amount", "price", "position", "block_time")
    rows = within(trades, params).select(*needed, T.is_real_usd().alias("_counted")).repartition("token", "wallet")
    seen = [F.min("block_time").alias("first_seen"), F.count("*").alias("all_trades")]
    grouped = rows.groupBy("token", "wallet").agg(*book(F.col("_counted")), *seen, *T.newest())
    partials = materialize(_only_held(grouped, _enough(params)), "wallet-partials")
    tokens = (
        partials.groupBy("token")
        .agg(F.min("first_seen").alias("launch_time"), F.sum("all_trades").alias("_trades"), *T.newest_merged())
        .where(F.col("_trades") >= params.min_token_trades)
        .select("token", "launch_time", F.col("newest_price").alias("latest_price"))
    )
    held = partials.where(_enough(params)).drop("first_seen", "all_trades", "newest", "newest_price")
    joined = join_by_key(held, materialize(tokens, "recent-tokens"), ["token"], limits=limits)
    return joined.withColumn("launchpad_name", F.lit(None).cast("string")).select(*COLUMNS)


def positions_sided(trades: DataFrame, launches: LaunchTable, params: Params) -> DataFrame:
    """Positions from trades naming their side; price from any trade of the token.

    A token with a position traded after its launch, hence inside the window,
    so its newest trade is found inside the window as well.
    """
    recent = within(trades, params)
    if params.launch_grain == "event":
        return _event_positions_separate(recent, launches, params)
    joined = launches.attach(recent, launches.rows.select("token", "launch_time"))
    counted = T.is_real_sided() & (F.col("block_time") >= F.col("launch_time"))
    return _token_positions(joined, counted, launches, _enough(params))


def positions_normalized(trades: DataFrame, launches: LaunchTable, params: Params) -> DataFrame:
    """Positions from signed trades; price from the same trades only."""
    rows = T.real_normalized(within(trades, params), params)
    if params.launch_grain == "event":
        return _event_positions_shared(rows, launches, params)
    return _token_positions(launches.trades_after(rows), F.lit(True), launches, F.col("invested") > 0)


def _token_positions(rows: DataFrame, counted: Column, launches: LaunchTable, keep: Column) -> DataFrame:
    partials = materialize(rows.groupBy("token", "wallet").agg(*book(counted), *T.newest()), "wallet-partials")
    held = partials.where(keep).drop("newest", "newest_price")
    held = launches.attach(held, launches.rows.select("token", "launch_time", "launchpad_name"))
    return launches.attach(held, token_prices(partials), "left").select(*COLUMNS)


# ---------------------------------------------------------------------------
# Every launch row counts. Joining trades with all launch rows would multiply
# the trades; instead each trade falls into one interval between launches, the
# intervals are aggregated, and only finished sums meet the launch rows.


def _moments(launches: LaunchTable) -> DataFrame:
    """Distinct launch times (token, _from, _copies, _rank); ``_copies`` counts the launch rows up to then.

    The window holds at most one row per second of the history for a token,
    however many launch rows it has.
    """
    by_time = Window.partitionBy("token").orderBy("launch_time")
    moments = launches.rows.groupBy("token", "launch_time").agg(F.count("*").alias("_rows"))
    return moments.select(
        "token",
        F.col("launch_time").alias("_from"),
        F.sum("_rows").over(by_time).alias("_copies"),
        F.row_number().over(by_time).alias("_rank"),
    )


_MARK = ("_from", "_copies", "_rank")
FEW_LAUNCHES = 16  # launch times of a token that may pass along with each of its trades


def _hour(time: str) -> Column:
    return F.date_trunc("hour", time).cast("timestamp_ntz")


def _day_starts(moments: DataFrame, params: Params) -> DataFrame:
    """The last launch before each day: (token, _day, _before), from the day after the first launch on."""
    last_day = F.lit(params.as_of.date())
    days = moments.groupBy("token", F.to_date("_from").alias("_on")).agg(F.max(F.struct(*_MARK)).alias("_before"))
    following = F.coalesce(F.lead("_on").over(Window.partitionBy("token").orderBy("_on")), last_day)
    spans = days.withColumn("_until", following).where(F.col("_until") > F.col("_on"))
    return spans.select("token", F.explode(F.sequence(F.date_add("_on", 1), F.col("_until"))).alias("_day"), "_before")


def _hour_starts(moments: DataFrame) -> DataFrame:
    """The last launch of the same day before each hour: (token, _hour, _earlier), at most 23 rows a day with launches."""
    hours = moments.groupBy("token", _hour("_from").alias("_on")).agg(F.max(F.struct(*_MARK)).alias("_earlier"))
    in_day = Window.partitionBy("token", F.to_date("_on")).orderBy("_on")
    last_hour = F.to_date("_on").cast("timestamp_ntz") + F.expr("interval 23 hours")
    spans = hours.withColumn("_until", F.coalesce(F.lead("_on").over(in_day), last_hour)).where(F.col("_until") > F.col("_on"))
    step = F.expr("interval 1 hour")
    return spans.select("token", F.explode(F.sequence(F.col("_on") + step, F.col("_until"), step)).alias("_hour"), "_earlier")


def _in_interval(rows: DataFrame, launches: LaunchTable, moments: DataFrame, params: Params) -> DataFrame:
    """Adds the last launch up to each trade (_from, _copies, _rank), NULL before the first.

    A token's few launches join its trades as one array. Tokens with more are read apart, see ``_by_hour``.
    """
    lists = moments.where(F.col("_rank") <= FEW_LAUNCHES + 1).groupBy("token")
    lists = materialize(lists.agg(F.array_sort(F.collect_list(F.struct(*_MARK))).alias("_marks")), "launch-lists")
    many = lists.where(F.size("_marks") > FEW_LAUNCHES).select("token")
    up_to = F.filter("_marks", lambda mark: mark["_from"] <= F.col("block_time"))
    joined = launches.attach(rows, lists.where(F.size("_marks") <= FEW_LAUNCHES))
    placed = joined.select(*rows.columns, F.try_element_at(up_to, F.lit(-1)).alias("_launch")).select(*rows.columns, "_launch.*")
    if many.isEmpty():
        return placed
    return placed.unionByName(_by_hour(rows, many, launches, moments.join(many, "token", "left_semi"), params))


def _by_hour(rows: DataFrame, tokens: DataFrame, launches: LaunchTable, moments: DataFrame, params: Params) -> DataFrame:
    """As ``_in_interval``, for tokens of any number of launches.

    Trades and launches of a token and hour pass by in order of time, and the last launch is
    carried forward; what was launched in earlier hours and on earlier days joins as one row per
    token and hour, and per token and day. So no trade meets more than one launch, and a hot
    token's trades are split by hour.
    """
    hours = materialize(_hour_starts(moments), "launch-hours")
    days = materialize(_day_starts(moments, params), "launch-days")
    trades = rows.select("*", _hour("block_time").alias("_hour"), F.to_date("block_time").alias("_day"), F.lit(1).alias("_kind"))
    marks = moments.select(
        "token", F.col("_from").alias("block_time"), _hour("_from").alias("_hour"), F.lit(0).alias("_kind"),
        F.struct(*_MARK).alias("_mark"),
    )
    ordered = Window.partitionBy("token", "_hour").orderBy("block_time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        join_by_key(trades, tokens, ["token"], "left_semi", limits=launches.limits)
        .unionByName(marks, allowMissingColumns=True)
        .withColumn("_mark", F.last("_mark", ignorenulls=True).over(ordered))
        .where(F.col("_kind") == 1)
    )
    joined = join_by_key(carried, hours, ["token", "_hour"], "left", limits=launches.limits)
    joined = join_by_key(joined, days, ["token", "_day"], "left", limits=launches.limits)
    placed = joined.select(*rows.columns, F.coalesce("_mark", "_earlier", "_before").alias("_launch"))
    return placed.select(*rows.columns, "_launch.*")


def _launch_groups(launches: LaunchTable) -> DataFrame:
    return launches.rows.groupBy("launchpad_name", "token", "launch_time").agg(F.count("*").alias("_same"))


def _event_positions_separate(rows: DataFrame, launches: LaunchTable, params: Params) -> DataFrame:
    """Each launch row gathers the trades from its own time on; all trades of the token may quote."""
    moments = materialize(_moments(launches), "launch-moments")
    counted = T.is_real_sided() & F.col("_rank").isNotNull()
    placed = _in_interval(rows, launches, moments, params)
    partials = materialize(placed.groupBy("token", "wallet", "_rank").agg(*book(counted), *T.newest()), "wallet-partials")
    parts = partials.where(F.col("trade_count") > 0)
    # Totals from an interval to the end are those of the launches after the wallet's interval before, up to its own.
    onward = Window.partitionBy("token", "wallet").orderBy(F.col("_rank").desc())
    totals = parts.select(
        "token",
        "wallet",
        F.coalesce(F.lead("_rank").over(onward), F.lit(0)).alias("_after"),
        F.col("_rank").alias("_until"),
        *[F.sum(c).over(onward).alias(c) for c in (*SUMS, "trade_count")],
        F.min("first_trade").over(onward).alias("first_trade"),
        F.max("last_trade").over(onward).alias("last_trade"),
    )
    each = totals.withColumn("_rank", F.explode(F.sequence(F.col("_after") + 1, F.col("_until")))).drop("_after", "_until")
    ranks = moments.select("token", F.col("_from").alias("launch_time"), "_rank")
    groups = materialize(_launch_groups(launches).join(ranks, ["token", "launch_time"]), "launch-groups")
    joined = join_by_key(each, groups, ["token", "_rank"], small=launches.small, limits=launches.limits)
    held = _times(joined, F.col("_same")).where(_enough(params))
    return launches.attach(held, token_prices(partials), "left").select(*COLUMNS)


def _event_positions_shared(rows: DataFrame, launches: LaunchTable, params: Params) -> DataFrame:
    """Each launch row gathers all trades kept for any launch row of its token, once per such row."""
    moments = materialize(_moments(launches), "launch-moments")
    after = _in_interval(rows, launches, moments, params).where(F.col("_from").isNotNull())
    grouped = after.groupBy("token", "wallet", "_copies").agg(*book(F.lit(True)), *T.newest())
    partials = materialize(grouped, "wallet-partials")
    weighted = _times(partials, F.col("_copies"))
    totals = weighted.groupBy("token", "wallet").agg(
        *[F.sum(c).alias(c) for c in (*SUMS, "trade_count")],
        F.min("first_trade").alias("first_trade"),
        F.max("last_trade").alias("last_trade"),
    )
    groups = materialize(_launch_groups(launches), "launch-groups")
    held = _times(launches.attach(totals, groups), F.col("_same")).where(F.col("invested") > 0)
    return launches.attach(held, token_prices(partials), "left").select(*COLUMNS)


def _times(df: DataFrame, factor: Column) -> DataFrame:
    """Sums and counts taken ``factor`` (below 10^9) times, all nine decimals kept.

    A sum beyond 10^19 becomes NULL, and with it the position's result.
    """
    times = {c: F.col(c).try_cast(AMOUNT) * factor.cast("decimal(9,0)") for c in SUMS}
    return df.withColumns({**times, "trade_count": F.col("trade_count") * factor})
