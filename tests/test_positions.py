"""Hand-made trades, one trap per test."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import BAGS, BONK, PUMP, T0, at, calls, dicts, narrow, rows_of, sided, signed, wide
from walletscope.operators import positions
from walletscope.operators import returns as R
from walletscope.operators import trades as T
from walletscope.operators.joins import JoinLimits
from walletscope.operators.launches import launches_narrow, launches_wide
from walletscope.params import NORMALIZED, SIDED, USD
from walletscope.plans import rollups
from walletscope.plans.flows import normalized_flow, sided_flow, usd_flow
from walletscope.sources.tables import sided_trades

P_SIDED = SIDED.with_(as_of=T0 + timedelta(days=60))
P_MAIN = NORMALIZED.with_(as_of=T0 + timedelta(days=60))
P_USD = USD.with_(as_of=T0 + timedelta(days=60), min_token_trades=1)
SORT_MERGE = JoinLimits(broadcast_bytes=0)


def one(df):
    (row,) = dicts(df)
    return row


def sided_book(spark, trades, launches=None, params=P_SIDED):
    launches = launches or [("A", at(), "c", PUMP)]
    return sided_flow(narrow(spark, launches), sided(spark, trades), params).returns


def test_readme_example(spark):
    """2.5 in, 62.5 gained, entered after 3 hours, held 4 days."""
    book = sided_book(
        spark,
        [("A", "w", "buy", 2.5, 100, 0.025, at(3)), ("A", "w", "sell", 65, 100, 0.65, at(3 + 96))],
    )
    row = one(R.moonshots_sided(book, P_SIDED))
    assert row["return_percentage"] == 2500.0 and row["profit_multiple"] == 25.0
    assert row["profit_sol"] == 62.5 and row["tokens_remaining"] == 0.0
    assert row["moonshot_category"] == "20-49x (2000-4999%)"
    assert row["entry_timing"] == "Very Early (1-6h)" and row["hold_strategy"] == "Swing (1-7d)"


def test_usd_position_of_100_gaining_2500(spark):
    rows = [("A", "w", 10, 100, 10.0, at()), ("A", "w", -10, 2600, 260.0, at(5))]
    row = one(R.moonshots_usd(usd_flow(signed(spark, rows), P_USD).returns, P_USD))
    assert (row["return_pct"], row["profit_usd"]) == (2500.0, 2500.0)
    assert row["wallet_link"].endswith("/account/w") and row["token_link"].endswith("/token/A")


@pytest.mark.parametrize("amount,kept", [(0.0499, 0), (0.05, 1)])
def test_minimum_investment_sided(spark, amount, kept):
    assert sided_book(spark, [("A", "w", "buy", amount, 1, 1.0, at(1))]).count() == kept


@pytest.mark.parametrize("amount,kept", [(49.99, 0), (50, 1)])
def test_minimum_investment_usd(spark, amount, kept):
    assert usd_flow(signed(spark, [("A", "w", 1, amount, 1.0, at())]), P_USD).positions.count() == kept


@pytest.mark.parametrize("trades,kept", [(9, 0), (10, 1)])
def test_minimum_trades_count_rows_that_enter_no_sum(spark, trades, kept):
    rows = [("A", "w", 1, 60, 1.0, at())] + [("A", "x", 0, 0, 1.0, at(i)) for i in range(1, trades)]
    params = P_USD.with_(min_token_trades=10)
    assert usd_flow(signed(spark, rows), params).positions.count() == kept


def test_negative_balance_is_valued_negatively(spark):
    row = one(sided_book(spark, [("A", "w", "buy", 1, 1, 1.0, at(1)), ("A", "w", "sell", 1, 5, 2.0, at(2))]))
    assert row["balance"] == Decimal(-4) and row["unrealized"] == -8.0 and row["total_pnl"] == -8.0


@pytest.mark.parametrize("price", [None, float("nan")])
def test_missing_newest_price_counts_as_zero(spark, price):
    book = sided_book(spark, [("A", "w", "buy", 1, 1, 5.0, at(1)), ("A", "x", "buy", 1, 1, price, at(2))])
    assert {r["unrealized"] for r in dicts(book)} == {0.0}
    assert R.moonshots(book, P_SIDED).count() == 0


def test_tied_newest_prices_take_the_last_position_in_any_order(spark):
    trades = [("A", f"w{i}", 1, 1, p, at(1), f"t{i}", i) for i, p in enumerate((3.0, 9.0, None, 5.0))]
    params = P_USD.with_(min_invested=Decimal(0))
    for rows in (trades, trades[::-1]):
        assert {r["latest_price"] for r in dicts(usd_flow(signed(spark, rows), params).positions)} == {5.0}
        assert {r["latest_price"] for r in dicts(usd_flow(signed(spark, rows[:3] if rows is trades else rows[1:]), params).positions)} == {None}


def test_ties_without_positions_do_not_depend_on_order(spark):
    trades = [("A", f"w{i}", 1, 1, float(i), at(1), f"t{i}") for i in range(20)]
    params = P_USD.with_(min_invested=Decimal(0))
    found = [
        {r["latest_price"] for r in dicts(usd_flow(signed(spark, rows).drop("trade_index").repartition(n), params).positions)}
        for rows in (trades, trades[::-1]) for n in (1, 5)
    ]
    assert len(found[0]) == 1 and all(f == found[0] for f in found)


def test_tiny_amounts_are_trades(spark):
    """4e-10 tokens for 100 USD; the tokens vanish in nine decimals, the trade does not."""
    row = one(usd_flow(signed(spark, [("A", "w", "0.0000000004", 100, 1.0, at())]), P_USD).positions)
    assert row["invested"] == Decimal(100) and row["trade_count"] == 1 and row["tokens_bought"] == 0


@pytest.mark.parametrize("price", [float("inf"), float("-inf")])
def test_infinite_prices_count_as_missing(spark, price):
    book = sided_book(spark, [("A", "w", "buy", 1, 1, 5.0, at(1)), ("A", "x", "buy", 1, 0.001, price, at(2))])
    assert {r["unrealized"] for r in dicts(book)} == {0.0}
    assert R.moonshots(book, P_SIDED).count() == 0


def test_huge_profits_do_not_end_the_job(spark):
    rows = [("A", "w", 1e9, 60, 1.0, at()), ("A", "w", 1, 60, 4e20, at(1)), ("A", "x", 1, 60, 4e20, at(1))]
    returns = usd_flow(signed(spark, rows), P_USD).returns
    best = rollups.repeat_winners(returns, P_USD.with_(min_repeat_moonshots=1)).first()
    assert best["total_profit_usd"] == pytest.approx(4e29, rel=1e-6)
    assert R.moonshots_usd(returns, P_USD).count() == 2


def test_nothing_after_as_of_changes_a_result(spark):
    trades = [("A", "w", 1, 60, 2.0, at(1)), ("A", "w", 1, 600, 99.0, at(24 * 61))]
    assert rows_of(usd_flow(signed(spark, trades), P_USD).returns) == rows_of(usd_flow(signed(spark, trades[:1]), P_USD).returns)
    rows = [("A", "w", "buy", 1, 1, 2.0, at(1)), ("A", "w", "buy", 5, 1, 99.0, at(24 * 61))]
    for grain in ("token", "event"):
        params = P_SIDED.with_(launch_grain=grain)
        assert rows_of(sided_book(spark, rows, params=params)) == rows_of(sided_book(spark, rows[:1], params=params))
    late = narrow(spark, [("A", at(24 * 61), "c", PUMP)])
    assert launches_narrow(late, P_SIDED).count() == 0


@pytest.mark.parametrize("grain", ["token", "event"])
def test_nine_decimals_survive_both_grains(spark, grain):
    params = P_SIDED.with_(launch_grain=grain)
    rows = [("A", "w", "buy", "0.123456789", 1, 1.0, at(1)), ("A", "x", "buy", "0.049999600", 1, 1.0, at(1))]
    row = one(sided_book(spark, rows, params=params))
    assert row["wallet"] == "w" and row["invested"] == Decimal("0.123456789")
    main = params.with_(min_invested=Decimal("0.000000001"))
    flow = normalized_flow(wide(spark, [("t", at(), "A", "c", PUMP)]), calls(spark, []),
                           signed(spark, [("A", "w", 1, "0.123456789", 1.0, at(1))]), main)
    assert one(flow.returns)["invested"] == Decimal("0.123456789")


def test_many_launch_moments_in_a_day(spark):
    """50,000 launches of one token in a day; each trade meets only its own."""
    start = at().strftime("%Y-%m-%d %H:%M:%S")
    activity = spark.range(50_000).selectExpr(
        "'A' token_mint_address", f"timestamp_ntz'{start}' + interval 1 second * id block_time", "'c' creator_wallet",
        f"'{PUMP}' account", "'create_token' instruction_name")
    trades = sided(spark, [("A", f"w{i}", "buy", 1, 1, 1.0, at(0, i)) for i in range(5)])
    positions = sided_flow(activity, trades, P_SIDED.with_(launch_grain="event")).positions
    # the trade at minute i belongs to the launches of its seconds before
    counts = {r["wallet"]: r["count"] for r in positions.groupBy("wallet").count().collect()}
    assert counts == {f"w{i}": 60 * i + 1 for i in range(5)}


@pytest.mark.parametrize("limits", [JoinLimits(), SORT_MERGE], ids=["broadcast", "sort-merge"])
def test_a_hot_token_is_split_by_hour(spark, limits):
    """Random launches and trades of one token; no task gathers more than an hour of its trades."""
    rng = random.Random(1)
    launches = sorted({(at(rng.randrange(72), rng.randrange(60)), rng.choice([PUMP, BONK])) for _ in range(40)})
    trades = [("A", f"w{rng.randrange(9)}", "buy", 1, 1, 1.0, at(rng.randrange(96), rng.randrange(60))) for _ in range(600)]
    activity = narrow(spark, [("A", born, "c", pad) for born, pad in launches])
    flow = sided_flow(activity, sided(spark, trades), P_SIDED.with_(launch_grain="event"), limits)
    got = {(r["launchpad_name"], r["launch_time"], r["wallet"]): (int(r["invested"]), r["trade_count"]) for r in dicts(flow.positions)}
    names, want = {PUMP: "pump.fun", BONK: "letsbonk"}, {}
    for born, pad in launches:
        for _, wallet, *_, when in trades:
            if when >= born:
                invested, count = want.get((names[pad], born, wallet), (0, 0))
                want[names[pad], born, wallet] = (invested + 1, count + 1)
    assert got == want
    table = T.LaunchTable(launches_narrow(activity, P_SIDED.with_(launch_grain="event")), limits)
    moments = positions._moments(table)
    placed = positions._in_interval(sided_trades(sided(spark, trades)), table, moments, P_SIDED)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window \[[^\n]*\[token#\d+, _hour#\d+", plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_price_scope_sided_takes_any_trade_of_the_token(spark):
    """Zero amounts do not trade, yet quote."""
    book = sided_book(
        spark, [("A", "w", "buy", 1, 1, 2.0, at(1)), ("A", "x", "sell", 0, 0, 9.0, at(5))]
    )
    assert one(book)["latest_price"] == 9.0


def test_price_scope_normalized_takes_kept_trades_only(spark):
    activity = wide(spark, [("t", at(), "A", "c", PUMP)])
    rows = [("A", "w", 1, 1, 2.0, at(1)), ("A", "x", 0, 0, 9.0, at(5)), ("A", "y", 1, 0, 8.0, at(24 * 61))]
    book = normalized_flow(activity, calls(spark, []), signed(spark, rows), P_MAIN).returns
    assert one(book)["latest_price"] == 2.0


def test_trades_before_launch_stay_out(spark):
    row = one(sided_book(spark, [("A", "w", "buy", 9, 9, 2.0, at(-1)), ("A", "w", "buy", 1, 1, 3.0, at(0))]))
    assert row["invested"] == Decimal(1) and row["entry_hours"] == 0 and row["trade_count"] == 1


def test_other_sides_count_as_trades_but_enter_no_sum(spark):
    row = one(
        sided_book(spark, [("A", "w", "buy", 1, 1, 1.0, at(1)), ("A", "w", "transfer", 7, 7, 1.0, at(30))])
    )
    assert row["trade_count"] == 2 and row["hold_hours"] == 29
    assert row["invested"] == Decimal(1) and row["received"] == 0 and row["balance"] == Decimal(1)


def test_zero_and_missing_amounts_tokens_and_chains_are_dropped(spark):
    good = signed(spark, [("A", "w", 1, 60, 1.0, at())])
    bad = signed(spark, [("A", "w", 0, 60, 1.0, at(1)), ("A", "w", 1, 0, 1.0, at(1)), ("A", "w", None, 60, 1.0, at(1)),
                         ("A", "w", 1, None, 1.0, at(1)), (None, "w", 1, 60, 1.0, at(1))])
    other = signed(spark, [("A", "w", 1, 60, 99.0, at(9))], chain="ethereum")
    row = one(usd_flow(good.unionByName(bad).unionByName(other), P_USD).positions)
    assert row["invested"] == Decimal(60) and row["trade_count"] == 1 and row["latest_price"] == 1.0


def test_negative_usd_counts_in_the_normalized_variant_only(spark):
    rows = [("A", "w", 1, -60, 1.0, at(1))]
    main = normalized_flow(wide(spark, [("t", at(), "A", "c", PUMP)]), calls(spark, []), signed(spark, rows), P_MAIN)
    assert one(main.returns)["invested"] == Decimal(60)
    assert usd_flow(signed(spark, rows), P_USD).positions.count() == 0


def test_window_edges(spark):
    start = P_SIDED.window_start
    activity = narrow(spark, [("A", start, "c", PUMP), ("B", start - timedelta(seconds=1), "c", PUMP)])
    assert [r["token"] for r in dicts(launches_narrow(activity, P_SIDED))] == ["A"]


def test_narrow_launches_need_a_known_program_and_a_creation(spark):
    activity = narrow(spark, [("A", at(), "c", PUMP, "mint"), ("B", at(), "c", "x"), ("C", at(), "c", BAGS)])
    assert [(r["token"], r["launchpad_name"]) for r in dicts(launches_narrow(activity, P_SIDED))] == [("C", "bags")]


def test_wide_launches_name_the_program_first_and_fall_back_to_calls(spark):
    activity = wide(spark, [("t1", at(), "A", "c", BONK), ("t2", at(), "B", "c", "x"), ("t3", at(), "C", "c", None),
                            ("t4", at(), "D", "c", "x"), ("t5", at(), None, "c", PUMP), ("t6", at(), "E", "c", "x")])
    instruction = calls(spark, [("t1", at(), PUMP), ("t2", at(), PUMP), ("t2", at(), PUMP), ("t3", at(), PUMP),
                                ("t4", at(1), PUMP), ("t6", at(), BONK)])
    for grain in ("token", "event"):
        found = launches_wide(activity, instruction, P_MAIN.with_(launch_grain=grain))
        assert {r["token"]: r["launchpad_name"] for r in dicts(found)} == {
            "A": "letsbonk", "B": "pump.fun", "C": "pump.fun"}
        assert found.count() == 3


def test_token_grain_keeps_the_earliest_launch(spark):
    launches = [("A", at(5), "c", PUMP), ("A", at(), "d", BONK), ("A", at(), "c", BONK)]
    row = one(launches_narrow(narrow(spark, launches), P_SIDED))
    assert (row["launch_time"], row["launchpad_name"], row["creator"]) == (at(), "letsbonk", "c")


def test_empty_inputs_keep_the_schema(spark):
    flow = usd_flow(signed(spark, []), P_USD)
    assert flow.positions.count() == 0
    assert R.moonshots_usd(flow.returns, P_USD).columns[:2] == ["trader_wallet", "token_mint_address"]
    main = normalized_flow(wide(spark, []), calls(spark, []), signed(spark, []), P_MAIN)
    assert main.returns.count() == 0


# --- every launch row counts ------------------------------------------------

TRADES = [
    ("A", "w", 4, 40, 10.0, at(1)), ("A", "w", -1, 30, 30.0, at(30)), ("A", "x", 2, 90, 45.0, at(49)),
    ("A", "w", 1, 7, 7.0, at(100)), ("B", "w", 3, 10, 5.0, at(2)), ("A", "y", 2, 11, 4.0, at(-3)),
    ("A", "x", -1, 5, 5.0, at(24 * 70)),
]
LAUNCHES = [
    ("t1", at(), "A", "c1", PUMP), ("t2", at(), "A", "c2", PUMP), ("t3", at(24), "A", "c1", BONK),
    ("t4", at(24.5), "A", "c1", BONK), ("t5", at(99), "A", "c1", PUMP), ("t6", at(), "B", "c1", BAGS),
    ("t7", at(24), "A", "c1", PUMP),
]


def _brute_force(launches, trades, leak, minimum):
    """The joins spelled out over Python rows; leak: trades kept for one launch row count for all."""
    out = {}
    for pad, token, born, _ in launches:
        pool = [t for l in launches for t in trades if l[1] == token == t[0] and t[5] >= l[2]] if leak else [
            t for t in trades if t[0] == token and t[5] >= born]
        for token_, wallet, qty, usd, _, when, *_ in pool:
            row = out.setdefault((pad, token, born, wallet), [0, 0, 0, 0, when, when])
            row[0] += usd if qty > 0 else 0
            row[1] += usd if qty < 0 else 0
            row[2] += qty
            row[3] += 1
            row[4], row[5] = min(row[4], when), max(row[5], when)
    return {k: tuple(v) for k, v in out.items() if v[0] >= minimum and v[0] > 0}


def _as_dict(positions):
    return {
        (r["launchpad_name"], r["token"], r["launch_time"], r["wallet"]): (
            int(r["invested"]), int(r["received"]), int(r["balance"]), r["trade_count"], r["first_trade"], r["last_trade"])
        for r in dicts(positions)
    }


@pytest.mark.parametrize("limits", [JoinLimits(), SORT_MERGE], ids=["broadcast", "sort-merge"])
def test_event_grain_normalized_equals_the_spelled_out_joins(spark, limits):
    params = P_MAIN.with_(launch_grain="event")
    flow = normalized_flow(wide(spark, LAUNCHES), calls(spark, []), signed(spark, TRADES), params, limits)
    pads = {PUMP: "pump.fun", BONK: "letsbonk", BAGS: "bags"}
    launches = [(pads[p], token, born, owner) for _, born, token, owner, p in LAUNCHES]
    kept = [t for t in TRADES if t[5] <= params.as_of]
    assert _as_dict(flow.positions) == _brute_force(sorted(set(launches)), kept, True, 0)


@pytest.mark.parametrize("limits", [JoinLimits(), SORT_MERGE], ids=["broadcast", "sort-merge"])
def test_event_grain_sided_equals_the_spelled_out_join(spark, limits):
    params = P_SIDED.with_(launch_grain="event")
    rows = [(t, w, "buy" if q > 0 else "sell", usd, abs(q), p, when) for t, w, q, usd, p, when in TRADES]
    activity = narrow(spark, [(token, born, owner, p) for _, born, token, owner, p in LAUNCHES])
    flow = sided_flow(activity, sided(spark, rows), params, limits)
    pads = {PUMP: "pump.fun", BONK: "letsbonk", BAGS: "bags"}
    launches = [(pads[p], token, born, owner) for _, born, token, owner, p in LAUNCHES]
    want, kept = {}, [t for t in TRADES if t[5] <= params.as_of]
    for pad, token, born, owner in set((a, b, c, None) for a, b, c, _ in launches):
        copies = sum(1 for l in launches if l[:3] == (pad, token, born))
        single = _brute_force([(pad, token, born, None)], kept, False, 0)
        for key, (i, r, b, n, first, last) in single.items():
            want[key] = (i * copies, r * copies, b * copies, n * copies, first, last)
    assert _as_dict(flow.positions) == want


@pytest.mark.parametrize("grain", ["token", "event"])
def test_sort_merge_route_gives_the_broadcast_result(spark, grain):
    params = P_MAIN.with_(launch_grain=grain)
    inputs = wide(spark, LAUNCHES), calls(spark, []), signed(spark, TRADES)
    assert rows_of(normalized_flow(*inputs, params).returns) == rows_of(
        normalized_flow(*inputs, params, SORT_MERGE).returns)


def test_usd_sort_merge_route_gives_the_broadcast_result(spark):
    rows = [("A", f"w{i % 7}", 1 + i % 3, 60 + i, 1.0 + i, at(i)) for i in range(40)]
    rows += [("B", "w1", 5, 70, 2.0, at(1))]
    raw = signed(spark, rows)
    assert rows_of(usd_flow(raw, P_USD).returns) == rows_of(usd_flow(raw, P_USD, SORT_MERGE).returns)


@pytest.mark.parametrize("few", [0, 2, 16])
@pytest.mark.parametrize("limits", [JoinLimits(), SORT_MERGE], ids=["broadcast", "sort-merge"])
def test_few_and_many_launches_of_a_token_give_the_same_positions(spark, limits, few, monkeypatch):
    """Tokens of one to seven launch times; those of up to ``few`` join as arrays, without a window over the trades."""
    monkeypatch.setattr(positions, "FEW_LAUNCHES", few)
    rng = random.Random(3)
    launches = [(f"T{t}", at(rng.randrange(72), rng.randrange(60)), "c", PUMP) for t in range(1, 8) for _ in range(t)]
    trades = [(f"T{rng.randrange(9)}", f"w{rng.randrange(4)}", "buy", 1, 1, 1.0, at(rng.randrange(-5, 96), 7)) for _ in range(400)]
    params = P_SIDED.with_(launch_grain="event")
    flow = sided_flow(narrow(spark, launches), sided(spark, trades), params, limits)
    got = {(r["token"], r["launch_time"], r["wallet"]): (int(r["invested"]), r["trade_count"]) for r in dicts(flow.positions)}
    want, copies = {}, Counter((token, born) for token, born, *_ in launches)
    for (token, born), times in copies.items():
        for of, wallet, *_, when in trades:
            if of == token and when >= born:
                invested, count = want.get((token, born, wallet), (0, 0))
                want[token, born, wallet] = (invested + times, count + times)
    assert got == want
    table = T.LaunchTable(launches_narrow(narrow(spark, launches), params), limits)
    placed = positions._in_interval(sided_trades(sided(spark, trades)), table, positions._moments(table), params)
    assert ("Window" in placed._jdf.queryExecution().executedPlan().toString()) == (few < 7)
