"""Shape of the physical plans, and results that do not depend on partitioning."""

import pytest

from helpers import DATA, rows_of
from walletscope.operators import filters, positions
from walletscope.operators import returns as R
from walletscope.operators import trades as T
from walletscope.operators.joins import JoinLimits
from walletscope.plans import registry as G
from walletscope.plans import rollups
from walletscope.plans.flows import normalized_flow, sided_flow, usd_flow
from walletscope.plans.registry import QUERIES
from walletscope.session import materialize
from walletscope.sources import adapters as A
from walletscope.sources.tables import signed_trades


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(spark, build):
    """How often lineitem is read, and the executed plans, while a flow is built and run."""
    plans = []

    def recorded(df, label="table"):
        plans.append(plan_of(df))
        return materialize(df, label)

    with pytest.MonkeyPatch.context() as patch:
        for module in (positions, T, rollups, G):
            patch.setattr(module, "materialize", recorded)
        flow = build()
        plans.append(plan_of(flow.returns))
    return sum(p.count("lineitem.parquet") for p in plans), plans


BUILDS = {
    "usd": lambda spark, limits: usd_flow(A.trades_signed(spark, DATA), A.USD_PARAMS, limits),
    **{
        f"sided {grain}": lambda spark, limits, grain=grain: sided_flow(
            A.activity_narrow(spark, DATA), A.trades_sided(spark, DATA), A.SIDED_PARAMS.with_(launch_grain=grain), limits
        )
        for grain in ("token", "event")
    },
    **{
        f"normalized {grain}": lambda spark, limits, grain=grain: normalized_flow(
            A.activity_wide(spark, DATA), A.instruction_calls(spark, DATA), A.trades_signed_compressed(spark, DATA),
            A.NORMALIZED_PARAMS.with_(launch_grain=grain), limits
        )
        for grain in ("token", "event")
    },
}


STORED = {
    "launchpad_volume": ["launches"],
    "launch_to_first_trade": ["launches"],
    "token_traders": ["launches"],
    "drill_wallet": ["launches", "wallet-partials", "positions", "drill-key"],
    "drill_launchpad": ["launches", "wallet-partials", "positions", "launchpads", "drill-key"],
}


@pytest.mark.parametrize("name", STORED)
def test_queries_store_what_they_read(spark, name):
    """No positions for queries of trades and launches; the key of a drill-down is run once."""
    stored = []

    def recorded(df, label="table"):
        stored.append(label)
        return materialize(df, label)

    with pytest.MonkeyPatch.context() as patch:
        for module in (positions, T, rollups, G, filters):
            patch.setattr(module, "materialize", recorded)
        plan = plan_of(QUERIES[name](spark, DATA))
    assert stored == STORED[name]
    assert plan.count("lineitem.parquet") == (name in ("launchpad_volume", "launch_to_first_trade", "token_traders"))


@pytest.mark.parametrize("limits", [JoinLimits(), JoinLimits(broadcast_bytes=0)], ids=["broadcast", "merge"])
@pytest.mark.parametrize("name", BUILDS)
def test_trades_are_read_once_and_hash_aggregated(spark, name, limits):
    read, plans = scans(spark, lambda: BUILDS[name](spark, limits))
    assert read == 1
    (plan,) = [p for p in plans if "lineitem.parquet" in p]
    assert "partial_max_by" in plan and "partial_sum" in plan
    assert not any("CartesianProduct" in p or "NestedLoop" in p for p in plans)
    assert "SortAggregate" not in plan and "SortAggregate" not in plans[-1]
    if limits.broadcast_bytes:
        assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("variant", [G.usd, G.sided, G.normalized])
def test_no_python_in_the_plans(spark, variant):
    plan = plan_of(variant(spark, DATA).returns)
    assert "Python" not in plan and "SinglePartition" not in plan


def test_time_window_reaches_the_scan(spark):
    tokens = T.recent_tokens(signed_trades(A.trades_signed(spark, DATA)), A.USD_PARAMS)
    plan = plan_of(tokens)
    assert "GreaterThanOrEqual(l_shipdate" in plan
    schema = plan.split("ReadSchema: ")[1]
    assert "l_linestatus" not in schema


def test_top_k_keeps_rows_per_partition(spark):
    assert "TakeOrderedAndProject" in plan_of(R.moonshots_usd(G.usd(spark, DATA).returns, A.USD_PARAMS))


def test_large_ranking_has_no_single_task(spark):
    returns = G.stored(G.normalized(spark, DATA))
    ranked = rollups.wallet_summary(returns, A.NORMALIZED_PARAMS, single_task_rows=0)
    plan = plan_of(ranked)
    # Only the totals, one row per range, meet in a single task.
    singles = [i for i, line in enumerate(plan.splitlines()) if "Exchange SinglePartition" in line]
    for index in singles:
        assert "_total" in "".join(plan.splitlines()[index + 1 : index + 2])
    small = rollups.wallet_summary(returns, A.NORMALIZED_PARAMS)
    assert ranked.schema == small.schema and rows_of(ranked) == rows_of(small)


def test_launchpad_median_routes_agree(spark):
    returns = G.stored(G.normalized(spark, DATA))
    small = rollups.launchpad_comparison(returns)
    large = rollups.launchpad_comparison(returns, single_task_rows=0)
    assert small.schema == large.schema and rows_of(G.published(small)) == rows_of(G.published(large))


def test_positions_without_a_launchpad_are_compared_too(spark):
    for rows in (0, 1_000_000):
        (row,) = rollups.launchpad_comparison(G.usd(spark, DATA).returns, single_task_rows=rows).collect()
        assert row.launchpad_name is None and row.total_trades > 0 and row.median_return_pct is not None


@pytest.mark.parametrize("name", ["moonshots_usd", "moonshots_main", "wallet_moonshots", "launchpad_comparison"])
def test_results_do_not_depend_on_partitioning(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for parts in ("1", "4", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append(rows_of(QUERIES[name](spark, DATA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_counts_nest_and_balances_add_up(spark):
    returns = G.stored(G.normalized(spark, DATA))
    bad = rollups.token_success(returns, A.NORMALIZED_PARAMS).where(
        "traders_with_10000plus > traders_with_5000plus or traders_with_5000plus > traders_with_1000plus"
        " or traders_with_1000plus > total_trades or unique_traders > total_trades"
    )
    assert bad.count() == 0
    wrong = returns.where("balance <> tokens_bought - tokens_sold or entry_hours < 0 or hold_hours < 0")
    assert wrong.count() == 0


def test_usd_trades_are_dealt_before_they_are_combined(spark):
    """States of a hash aggregate, wider than the trades, are neither spilled by the scan's tasks nor shuffled."""
    _, plans = scans(spark, lambda: BUILDS["usd"](spark, JoinLimits()))
    (plan,) = [p for p in plans if "lineitem.parquet" in p]
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("partial_max_by") < plan.index("Exchange hashpartitioning")
