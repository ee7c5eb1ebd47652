"""Any split of the trades into batches, in any order, gives the positions of one batch."""

import random

import pytest

from helpers import at, rows_of, signed
from walletscope.operators.joins import JoinLimits
from walletscope.params import USD
from walletscope.plans.flows import usd_flow
from walletscope.session import new_folder
from walletscope.sources.tables import signed_trades
from walletscope.streaming.alerts import activity_spikes, hourly_activity
from walletscope.streaming.jobs import CATCH_UP, ActivityJob, PositionJob, arrivals, read_trade_stream

PARAMS = USD.with_(as_of=at(24 * 20), lookback_days=18, min_token_trades=3)


def trades(n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        quantity = rng.choice([0, 1, 2, 3, -1, -2])
        usd = rng.choice([0, 20, 60, 90])
        price = rng.choice([None, 1.0, 5.0, 400.0, 2000.0])
        when = at(rng.randrange(0, 24 * 20), rng.choice([0, 0, 30]))  # the first two days lie before the window
        rows.append((rng.choice("ABCD"), f"w{rng.randrange(6)}", quantity, usd, price, when, f"tx{i}"))
    return rows


def deliver(spark, job, *parts):
    """Each part arrives as one more delivery; the job catches up. The last query."""
    inbox, query = f"{job.root}-inbox", None
    for part in parts:
        signed(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        query = job.start(read_trade_stream(spark, inbox), CATCH_UP)
        query.awaitTermination()
    return query


def test_random_batches_with_late_repeated_and_replayed_trades(spark):
    rows = trades()
    job = PositionJob(spark, new_folder(spark, "test"), PARAMS)
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    deliver(spark, job, shuffled[:30], shuffled[30:31], shuffled[20:80], shuffled[80:] + shuffled[:5])
    want = rows_of(usd_flow(signed(spark, rows), job.current()).returns)
    assert rows_of(job.returns()) == want and len(want) > 5
    tiny = JoinLimits(broadcast_bytes=0)
    assert rows_of(PositionJob(spark, job.root, PARAMS, tiny).returns()) == want


def test_a_batch_that_fails_is_repeated(spark):
    """The first attempt at a batch ends before its alerts are written."""
    rows = trades(60)
    job = PositionJob(spark, new_folder(spark, "test"), PARAMS)
    deliver(spark, job, rows[:40])
    whole, inbox = job._process, f"{job.root}-inbox"

    def ends_early(changed, batch):
        job._write(changed, "changes", batch)
        raise RuntimeError("lost")

    job._process = ends_early
    signed(spark, rows[40:]).coalesce(1).write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="lost"):
        job.start(read_trade_stream(spark, inbox), CATCH_UP).awaitTermination()
    job._process = whole
    job.start(read_trade_stream(spark, inbox), CATCH_UP).awaitTermination()
    assert rows_of(job.returns()) == rows_of(usd_flow(signed(spark, rows), job.current()).returns)


def test_alerts_come_once_when_a_position_crosses(spark):
    job = PositionJob(spark, new_folder(spark, "test"), PARAMS.with_(min_token_trades=1, min_moonshot_traders=2))
    deliver(
        spark,
        job,
        [("A", "w", 10, 100, 10.0, at(60), "1"), ("A", "x", 10, 100, 10.0, at(60), "2")],
        # one trade of a third wallet moves the price, hence every holder
        [("A", "y", 1, 200, 200.0, at(61), "3")],
        [("A", "y", 1, 210, 210.0, at(62), "4"), ("B", "y", 1, 60, 60.0, at(62), "5")],
        # the price falls, and rises once more
        [("A", "y", 1, 20, 20.0, at(63), "6")],
        [("A", "y", 1, 300, 300.0, at(64), "7")],
    )
    found = [(r.token, r.wallet, r.batch) for r in job.alerts("moonshot_alerts").orderBy("batch", "wallet").collect()]
    assert found == [("A", "w", 1), ("A", "x", 1), ("A", "w", 4), ("A", "x", 4)]
    tokens = [(r.token, r.moonshot_traders, r.batch) for r in job.alerts("token_alerts").orderBy("batch").collect()]
    assert tokens == [("A", 2, 1), ("A", 2, 4)]
    # Only what crossed is kept of the past.
    crossed = job._stored("crossings").groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in crossed] == [(1, 3), (3, 3), (4, 3)]


def test_equal_fills_of_a_transaction_count_each(spark):
    rows = [("A", "w", 1, 100, 1.0, at(60), "t", 7), ("A", "w", 1, 100, 1.0, at(60), "t", 8)]
    job = PositionJob(spark, new_folder(spark, "test"), PARAMS.with_(min_token_trades=1))
    deliver(spark, job, rows, rows[1:])  # delivered once more
    want = usd_flow(signed(spark, rows), job.current()).returns
    assert rows_of(job.returns()) == rows_of(want)
    assert job.returns().first()["invested"] == 200 and job.returns().first()["trade_count"] == 2


def test_the_window_moves_with_the_data(spark):
    """Two batches a day apart, each judged by its own window."""
    params = PARAMS.with_(lookback_days=1, min_token_trades=1)
    job = PositionJob(spark, new_folder(spark, "test"), params)
    first = [("A", "w", 1, 100, 1.0, at(1), "1"), ("B", "w", 1, 100, 1.0, at(30), "2")]
    second = [("A", "w", 1, 300, 3.0, at(50), "3"), ("C", "w", 1, 100, 3.0, at(54), "4")]
    for number, batch in enumerate((first, second)):
        deliver(spark, job, batch)
        seen = signed(spark, (first + second) if number else first)
        as_of = at(54) if number else at(30)
        assert job.current().as_of == as_of
        assert rows_of(job.returns()) == rows_of(usd_flow(seen, params.with_(as_of=as_of)).returns)
    assert {r["token"] for r in job.returns().collect()} == {"A", "B", "C"}
    assert {r["invested"] for r in job.returns().where("token = 'A'").collect()} == {300}  # the first day is past
    assert job.current(upto=0).as_of == at(30)


def test_state_expires_and_trades_from_before_the_window_stay_out(spark):
    params = PARAMS.with_(min_token_trades=1, lookback_days=3)
    job = PositionJob(spark, new_folder(spark, "test"), params)
    batches = [[(t, f"w{i}", 10, 100, 10.0 * 15**i, at(24 * 2 * i), f"{t}{i}") for t in "AB"] for i in range(7)]
    query = deliver(spark, job, *batches, [("A", "w0", 10, 100, 10.0, at(1), "late"), ("A", "w6", 1, 1, 1e9, at(289), "new")])
    assert job.alerts("moonshot_alerts").count() > 0
    everything = signed(spark, [row for batch in batches for row in batch] + [("A", "w6", 1, 1, 1e9, at(289), "new")])
    assert rows_of(job.returns()) == rows_of(usd_flow(everything, job.current()).returns)
    kept = [operator.numRowsTotal for operator in query.recentProgress[-1].stateOperators]
    assert max(kept) < 14
    assert sum(operator.numRowsDroppedByWatermark for operator in query.recentProgress[-1].stateOperators) >= 1


def test_trades_later_than_the_clock_change_nothing_but_a_count(spark):
    rows = trades(60)
    future = [("A", "w", 1, 100, 1e6, at(24 * 365 * 75), "2099"), ("Z", "w", 1, 100, 1.0, at(24 * 21), "soon")]
    honest = PositionJob(spark, new_folder(spark, "test"), PARAMS, clock=at(24 * 20))
    fooled = PositionJob(spark, new_folder(spark, "test"), PARAMS, clock=at(24 * 20))
    deliver(spark, honest, rows[:40], rows[40:])
    query = deliver(spark, fooled, rows[:40] + future[:1])
    assert arrivals(query) == {"rows": 41, "later_than_clock": 1, "without_time": 0, "misfit_token_amount": 0, "misfit_usd_amount": 0}
    deliver(spark, fooled, rows[40:] + future)
    assert fooled.current() == honest.current()
    assert rows_of(fooled.returns()) == rows_of(honest.returns()) and honest.returns().count() > 3
    assert rows_of(fooled.alerts("moonshot_alerts")) == rows_of(honest.alerts("moonshot_alerts"))
    # Without a given clock, the trigger's time is the bound.
    live = PositionJob(spark, new_folder(spark, "test"), PARAMS)
    assert arrivals(deliver(spark, live, rows + future))["later_than_clock"] == 1


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_spikes_follow_late_trades_in_any_zone(spark, zone):
    root = new_folder(spark, "test")
    rows = [("A", "w", 1, 60, 1.0, at(i), f"a{i}") for i in range(24)]
    rows += [("A", "w", 1, 60, 1.0, at(24, m), f"b{m}") for m in range(3)]
    late = [("A", "w", 1, 60, 1.0, at(40), "c"), *[("A", "w", 1, 60, 1.0, at(24, 10 + m), f"d{m}") for m in range(2)]]
    job, before = ActivityJob(spark, f"{root}/state"), spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        for part in (rows, late):
            signed(spark, part).write.mode("append").parquet(f"{root}/inbox")
            job.start(read_trade_stream(spark, f"{root}/inbox"), CATCH_UP).awaitTermination()
        (spike,) = job.spikes().collect()
        assert (spike.token, spike.hour, spike.trades, spike.usual_trades) == ("A", at(24), 5, 1.0)
        assert [(r.hour, r.trades, r.batch) for r in job.alerts().collect()] == [(at(24), 5, 1)]
        assert rows_of(job.spikes()) == rows_of(activity_spikes(hourly_activity(signed_trades(signed(spark, rows + late)))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
