"""Roll-ups of evaluated positions by wallet, token, launchpad, week and size.

Inputs are returns (``operators.returns``), best read from the stored
positions table. Sums and means go through DECIMAL, so they are the same for
every partitioning. Medians of whole hours keep one counter per distinct hour
of the window, which is bounded; the median of returns is not, see
``launchpad_comparison``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.functions import labels as L
from walletscope.functions.scalars import exact_avg, exact_sum, instant, iso_week, percent, round_dec
from walletscope.operators.joins import null_safe_join
from walletscope.operators.ordered import SINGLE_TASK_ROWS, exact_quantile, ranked
from walletscope.operators.returns import moonshots
from walletscope.operators.trades import LaunchTable, token_traders
from walletscope.params import Params
from walletscope.session import materialize


def _reaching(threshold: float) -> Column:
    return F.count_if(F.col("return_pct") >= F.lit(float(threshold)))


def _total(column: str) -> Column:
    """Exact total of a DECIMAL column."""
    return F.sum(column).cast("double")


def _median_hours(column: str) -> Column:
    return F.percentile(column, 0.5)


def _rank_rows(column: str) -> Column:
    return F.rank().over(Window.orderBy(F.col(column).desc_nulls_last())).cast("bigint")


def wallet_moonshots(returns: DataFrame, params: Params, **rank_options) -> DataFrame:
    """Moonshots per wallet and launchpad, with wallet type and three ranks."""
    per_wallet = (
        moonshots(returns, params)
        .groupBy(F.col("wallet").alias("trader_wallet"), "launchpad_name")
        .agg(
            F.count("*").alias("moonshot_count"),
            _reaching(10000).alias("ultra_moonshots_100x"),
            _reaching(5000).alias("super_moonshots_50x"),
            _total("invested").alias("total_moonshot_investment"),
            exact_sum("total_pnl").alias("total_moonshot_profit"),
            exact_avg("return_pct").alias("avg_moonshot_return"),
            F.max("return_pct").alias("best_moonshot_return"),
            F.avg("entry_hours").alias("avg_entry_timing"),
            F.avg("hold_hours").alias("avg_hold_time"),
            F.max("last_trade").alias("latest_moonshot_trade"),
            F.min("first_trade").alias("first_moonshot_trade"),
        )
        .where(F.col("moonshot_count") >= params.min_wallet_moonshots)
        .select(
            "*",
            L.wallet_type("moonshot_count").alias("wallet_type"),
            round_dec(
                F.try_divide("total_moonshot_profit", "total_moonshot_investment"), 2
            ).alias("overall_roi_multiple"),
        )
    )
    ranks = {
        "profit_rank": "total_moonshot_profit",
        "frequency_rank": "moonshot_count",
        "peak_performance_rank": "best_moonshot_return",
    }
    return ranked(per_wallet, ranks, **rank_options).orderBy(
        F.col("total_moonshot_profit").desc(), "trader_wallet", "launchpad_name"
    )


def token_moonshots(returns: DataFrame, trades: DataFrame, launches: LaunchTable, params: Params) -> DataFrame:
    """Moonshots per token, also as a share of every wallet that ever traded it."""
    keys = ["launchpad_name", "token", "launch_time"]
    per_token = (
        moonshots(returns, params)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total_moonshot_traders"),
            _reaching(10000).alias("traders_100x_plus"),
            _reaching(5000).alias("traders_50x_plus"),
            _total("invested").alias("total_investment_volume"),
            exact_sum("total_pnl").alias("total_profits_created"),
            exact_avg("return_pct").alias("avg_trader_return"),
            F.max("return_pct").alias("highest_individual_return"),
            F.avg("entry_hours").alias("avg_entry_delay"),
            F.min("entry_hours").alias("fastest_entry"),
            _median_hours("entry_hours").alias("median_entry_delay"),
        )
        .where(F.col("total_moonshot_traders") >= params.min_moonshot_traders)
    )
    # Only the few tokens left need their traders over the whole history.
    per_token = materialize(per_token, "moonshot-tokens")
    tokens = per_token.select("token").distinct()
    with_all = launches.attach(per_token, token_traders(trades, launches, params, tokens), "left")
    share = percent(F.col("total_moonshot_traders"), F.col("all_traders"))
    return (
        with_all.withColumn("moonshot_trader_percentage", share)
        .drop("all_traders")
        .withColumnRenamed("token", "token_mint_address")
        .orderBy(
            F.col("total_moonshot_traders").desc(),
            F.col("total_profits_created").desc(),
            "token_mint_address",
            "launch_time",
        )
    )


def repeat_winners(returns: DataFrame, params: Params) -> DataFrame:
    """Wallets with several moonshots, over the launch-less positions."""
    per_wallet = (
        moonshots(returns, params)
        .groupBy(F.col("wallet").alias("trader_wallet"))
        .agg(
            F.count("*").alias("moonshot_count"),
            _total("invested").alias("_invested"),
            exact_sum("total_pnl").alias("_profit"),
            exact_avg("return_pct").alias("_average"),
            F.max("return_pct").alias("_best"),
            F.min("first_trade").alias("first_moonshot"),
            F.max("last_trade").alias("latest_moonshot"),
        )
        .where(F.col("moonshot_count") >= params.min_repeat_moonshots)
    )
    return per_wallet.orderBy(F.col("_profit").desc(), "trader_wallet").select(
        "trader_wallet",
        "moonshot_count",
        round_dec("_invested", 2).alias("total_invested_usd"),
        round_dec("_profit", 2).alias("total_profit_usd"),
        round_dec("_average", 2).alias("avg_return_pct"),
        round_dec("_best", 2).alias("best_return_pct"),
        L.wallet_type("moonshot_count").alias("trader_type"),
        "first_moonshot",
        "latest_moonshot",
    )


def wallet_summary(returns: DataFrame, params: Params, **rank_options) -> DataFrame:
    """Successful positions per wallet and launchpad.

    ``total_trades`` counts positions. Only positions of at least
    ``base_min_return`` enter, so the win rate is 100 unless that is below 0.
    """
    per_wallet = (
        returns.where(F.col("return_pct") >= F.lit(params.base_min_return))
        .groupBy(F.col("wallet").alias("trader_wallet"), "launchpad_name")
        .agg(
            F.countDistinct("token").alias("tokens_traded"),
            F.count("*").alias("total_trades"),
            _total("invested").alias("total_invested"),
            exact_sum("total_pnl").alias("total_profit_sol"),
            exact_avg("return_pct").alias("avg_return_pct"),
            F.max("return_pct").alias("best_return_pct"),
            F.min("return_pct").alias("worst_return_pct"),
            percent(F.count_if(F.col("return_pct") > 0), F.count("*")).alias("win_rate_pct"),
            _reaching(1000).alias("moonshot_count"),
            F.avg("hold_hours").alias("avg_hold_time_hours"),
            F.avg("entry_hours").alias("avg_entry_timing_hours"),
        )
        .where(F.col("moonshot_count") >= params.min_wallet_moonshots)
    )
    ranks = {
        "profit_rank": "total_profit_sol",
        "moonshot_rank": "moonshot_count",
        "consistency_rank": "win_rate_pct",
    }
    return ranked(per_wallet, ranks, **rank_options).orderBy(
        F.col("total_profit_sol").desc(), "trader_wallet", "launchpad_name"
    )


def top_wallets(returns: DataFrame, params: Params, rows: int = 10) -> DataFrame:
    """The wallets with the highest profit; a top-k needs no full ranking."""
    keys = ["trader_wallet", "launchpad_name"]
    per_wallet = (
        returns.where(F.col("return_pct") >= F.lit(params.base_min_return))
        .groupBy(F.col("wallet").alias("trader_wallet"), "launchpad_name")
        .agg(
            _reaching(1000).alias("moonshot_count"),
            _total("invested").alias("total_invested"),
            exact_sum("total_pnl").alias("total_profit_sol"),
        )
        .where(F.col("moonshot_count") >= params.min_wallet_moonshots)
    )
    return per_wallet.orderBy(F.col("total_profit_sol").desc(), *keys).limit(rows)


def launchpad_comparison(returns: DataFrame, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """All positions per launchpad; those without one are a group of their own.

    A launchpad may hold a third of all positions, nearly each with a return
    of its own. The built-in median keeps all distinct values of a group in
    one task, so it serves only up to ``single_task_rows`` positions; beyond,
    the same median is read off a range-partitioned running count.
    ``returns`` is read twice: pass a stored table.
    """
    per_launchpad = materialize(returns.groupBy("launchpad_name").agg(
        F.countDistinct("token").alias("total_tokens_launched"),
        F.countDistinct("wallet").alias("unique_traders"),
        F.count("*").alias("total_trades"),
        _reaching(1000).alias("moonshot_trades"),
        percent(_reaching(1000), F.count("*")).alias("moonshot_rate_pct"),
        _total("invested").alias("total_volume_invested"),
        exact_sum("total_pnl").alias("total_profits_generated"),
        exact_avg("return_pct").alias("avg_return_pct"),
        F.max("return_pct").alias("highest_return_pct"),
        F.max("total_pnl").alias("biggest_profit_sol"),
    ), "launchpads")
    if (per_launchpad.agg(F.sum("total_trades")).first()[0] or 0) <= single_task_rows:
        medians = returns.groupBy("launchpad_name").agg(F.percentile("return_pct", 0.5).alias("median_return_pct"))
    else:
        medians = exact_quantile(returns, ["launchpad_name"], "return_pct", "median_return_pct")
    # One row per launchpad from here on.
    return (
        null_safe_join(per_launchpad, medians, ["launchpad_name"], "left")
        .select(
            "*",
            _rank_rows("moonshot_rate_pct").alias("moonshot_rate_rank"),
            _rank_rows("avg_return_pct").alias("avg_return_rank"),
            _rank_rows("total_profits_generated").alias("total_profit_rank"),
        )
        .orderBy(F.col("moonshot_rate_pct").desc(), "launchpad_name")
    )


def token_success(returns: DataFrame, params: Params) -> DataFrame:
    """Successful positions per token, with shares of traders by return and a success tier."""
    counts = {pct: f"traders_with_{pct}plus" for pct in (1000, 5000, 10000)}
    per_token = (
        returns.where(F.col("return_pct") >= F.lit(params.base_min_return))
        .groupBy("launchpad_name", F.col("token").alias("token_mint_address"), "launch_time")
        .agg(
            F.countDistinct("wallet").alias("unique_traders"),
            F.count("*").alias("total_trades"),
            _total("invested").alias("total_investment_volume"),
            exact_sum("total_pnl").alias("total_profits"),
            exact_avg("return_pct").alias("avg_trader_return"),
            F.max("return_pct").alias("best_trader_return"),
            *[_reaching(pct).alias(name) for pct, name in counts.items()],
            F.min("entry_hours").alias("fastest_entry_hours"),
            F.avg("entry_hours").alias("avg_entry_timing_hours"),
            F.avg("hold_hours").alias("avg_hold_duration_hours"),
        )
        .where(F.col("unique_traders") >= params.min_unique_traders)
    )
    return per_token.select(
        "*",
        *[
            percent(F.col(name), F.col("unique_traders")).alias(f"pct_traders_{pct}plus")
            for pct, name in counts.items()
        ],
        L.token_success({pct: F.col(name) for pct, name in counts.items()}).alias("token_success_tier"),
    ).orderBy(F.col("traders_with_1000plus").desc(), F.col("total_profits").desc(), "token_mint_address", "launch_time")


def weekly_trends(returns: DataFrame, params: Params) -> DataFrame:
    """Moonshots per launchpad and launch week of the trend window."""
    recent = moonshots(returns, params).where(F.col("launch_time") >= instant(params.trend_start))
    return (
        recent.groupBy("launchpad_name", iso_week("launch_time").alias("launch_week"))
        .agg(
            F.countDistinct("token").alias("tokens_launched"),
            F.countDistinct("wallet").alias("unique_successful_traders"),
            _reaching(1000).alias("moonshot_trades"),
            exact_sum("total_pnl").alias("weekly_profits"),
            exact_avg("return_pct").alias("avg_weekly_return"),
            F.avg("entry_hours").alias("avg_entry_delay_hours"),
            _median_hours("entry_hours").alias("median_entry_delay_hours"),
            F.avg("hold_hours").alias("avg_hold_time_hours"),
            _median_hours("hold_hours").alias("median_hold_time_hours"),
        )
        .orderBy(F.col("launch_week").desc(), "launchpad_name")
    )


def trader_categories(returns: DataFrame, params: Params) -> DataFrame:
    """Moonshots per launchpad and investment size class."""
    return (
        moonshots(returns, params)
        .groupBy("launchpad_name", L.size_class("invested").alias("trader_category"))
        .agg(
            F.count("*").alias("trade_count"),
            F.countDistinct("wallet").alias("unique_traders"),
            F.try_divide(_total("invested"), F.count("*").cast("double")).alias("avg_investment"),
            exact_avg("total_pnl").alias("avg_profit"),
            exact_avg("return_pct").alias("avg_return_pct"),
            _reaching(5000).alias("ultra_success_count"),
            percent(_reaching(5000), F.count("*")).alias("ultra_success_rate"),
            F.avg("entry_hours").alias("avg_entry_timing"),
            F.avg("hold_hours").alias("avg_hold_time"),
            F.avg("trade_count").alias("avg_trades_per_token"),
        )
        .orderBy("launchpad_name", L.size_rank("trader_category"))
    )


def category_by_tier(returns: DataFrame, params: Params) -> DataFrame:
    """Moonshots per size class and return tier: the stacks of a category chart."""
    return (
        moonshots(returns, params)
        .groupBy(
            L.size_class("invested").alias("trader_category"),
            L.return_band("return_pct").alias("moonshot_tier"),
        )
        .agg(F.count("*").alias("trade_count"))
        .orderBy(L.size_rank("trader_category"), "moonshot_tier")
    )


def _window_stats(returns: DataFrame, label: Column, name: str) -> DataFrame:
    return returns.groupBy("launchpad_name", label.alias(name)).agg(
        F.count("*").alias("positions"),
        F.countDistinct("wallet").alias("unique_traders"),
        _reaching(1000).alias("moonshot_trades"),
        percent(_reaching(1000), F.count("*")).alias("moonshot_rate_pct"),
        exact_avg("return_pct").alias("avg_return_pct"),
        exact_sum("total_pnl").alias("total_profit"),
    )


def entry_window_stats(returns: DataFrame) -> DataFrame:
    """Success by how soon after launch a wallet entered."""
    return _window_stats(returns, L.entry_timing("entry_hours"), "entry_timing")


def hold_window_stats(returns: DataFrame) -> DataFrame:
    """Success by how long a wallet held."""
    return _window_stats(returns, L.hold_strategy("hold_hours"), "hold_strategy")
