from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import at, dicts, rows_of, sided, signed
from walletscope.operators.filters import drill, drill_among, filter_positions
from walletscope.params import USD, Params
from walletscope.plans import registry as G
from walletscope.plans.flows import usd_flow
from walletscope.session import materialize, new_folder, scratch, shared_dir
from walletscope.sources import schemas as S
from walletscope.sources import sinks
from walletscope.sources.tables import count_rejects, read_table, signed_trades, since

from helpers import DATA


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_every_format_reads_the_same(spark, fmt):
    rows = sided(spark, [("A", "w", "buy", 1.5, 2, 0.75, at(1)), ("B", "x", "sell", None, 2, None, at(2, 30))])
    path = new_folder(spark, "test")
    rows.write.format(fmt).option("header", True).save(path)
    assert rows_of(read_table(spark, path, S.TRADES_SIDED, fmt)) == rows_of(rows)


def test_values_that_do_not_fit_become_null_and_are_counted(spark):
    path = new_folder(spark, "test")
    raw = spark.sql(
        "select 'solana' blockchain, 'A' token_address, 'w' trader, cast(v as double) token_amount, 1.5D usd_amount,"
        " 2D token_price, 't' tx_id, timestamp_ntz'2024-01-01 00:00:00' block_time from values (1), (1e25) t(v)"
    )
    raw.write.parquet(path)
    table = read_table(spark, path, S.TRADES_SIGNED)
    assert table.schema["token_amount"].dataType == S.TRADES_SIGNED["token_amount"].dataType
    assert sorted(r["token_amount"] is None for r in dicts(table)) == [False, True]
    rejects = count_rejects(spark.read.parquet(path), S.TRADES_SIGNED).first()
    assert rejects.token_amount == 1 and rejects.usd_amount == 0


def test_stored_trades_are_pruned_by_day(spark):
    rows = signed(spark, [("A", f"w{i}", 1, 60, 1.0, at(24 * i)) for i in range(6)])
    path = new_folder(spark, "test")
    sinks.write_trades(rows, path, by=("blockchain",))
    trades = signed_trades(read_table(spark, path, S.TRADES_SIGNED))
    recent = since(trades, datetime(2024, 3, 4))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "(block_date#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert recent.count() == 3
    params = USD.with_(as_of=datetime(2024, 3, 10), lookback_days=6, min_token_trades=1)
    assert usd_flow(read_table(spark, path, S.TRADES_SIGNED), params).positions.count() == 3


def test_positions_are_stored_once_and_read_back(spark):
    returns = G.normalized(spark, DATA).returns
    path = new_folder(spark, "test")
    assert rows_of(sinks.write_positions(returns, path)) == rows_of(returns)


def test_filters_are_inclusive_and_checked(spark):
    returns = G.stored(G.normalized(spark, DATA))
    moment = returns.agg(F.min("first_trade")).first()[0]
    assert filter_positions(returns, start=moment, end=moment).count() >= 1
    assert filter_positions(returns, launchpads=["All"]).count() == returns.count()
    assert filter_positions(returns, size="All").count() == returns.count()
    assert filter_positions(returns, launchpads=["bags"]).select("launchpad_name").distinct().count() == 1
    assert filter_positions(returns, min_invested=Decimal(100)).agg(F.min("invested")).first()[0] >= 100
    with pytest.raises(ValueError):
        filter_positions(returns, min_return_pct=99)
    with pytest.raises(ValueError):
        filter_positions(returns, start=datetime(2020, 1, 1), end=datetime(2024, 1, 1))


def test_drill_downs(spark):
    returns = G.stored(G.normalized(spark, DATA))
    wallet = returns.first().wallet
    rows = drill(returns, "wallet", wallet)
    assert rows.count() == returns.where(F.col("wallet") == wallet).count() > 0
    assert rows_of(drill_among(returns, rows.select("wallet").distinct(), ["wallet"])) == rows_of(rows)
    with pytest.raises(ValueError):
        drill(returns, "invested", "1")


def test_parameters(spark):
    p = Params(as_of=datetime(2024, 4, 15, 13, 30))
    assert p.window_start == datetime(2024, 1, 16) and p.trend_start.date() == date(2024, 2, 15)
    with pytest.raises(ValueError):
        Params(launch_grain="row")


def test_intermediate_results_go_to_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert folder is None or shared_dir(spark) == folder.rstrip("/")


def test_scratch_tables_are_removed_and_others_kept(spark):
    kept = materialize(spark.range(3))
    with scratch(spark):
        inside = materialize(spark.range(5))
        assert inside.count() == 5
        folder = new_folder(spark, "probe").rsplit("/", 1)[0]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert "scratch-" in folder and not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    assert kept.count() == 3
