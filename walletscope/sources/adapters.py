"""The test tables seen as launch activity, instruction calls and trades.

Token = part, wallet = supplier, trade = line item. Two time scales: the plain
ship date, and ship days compressed to hours from 2024 on, so that hour-based
classes spread out. Parts launch ``p_size`` days into 2024; three part types
stand for the known launch programs, all others for unknown programs.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from walletscope.functions.labels import FALLBACK_PROGRAM, PROGRAMS
from walletscope.params import NORMALIZED, SIDED, USD

PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM")  # in the order of PROGRAMS
AS_OF = datetime(2024, 4, 15)

FIRST_DAY, LAST_DAY = datetime(1995, 1, 1), datetime(2002, 1, 1)  # ship dates lie between
USD_PARAMS = USD.with_(as_of=LAST_DAY, lookback_days=(LAST_DAY - FIRST_DAY).days)
SIDED_PARAMS = SIDED.with_(as_of=AS_OF)
NORMALIZED_PARAMS = NORMALIZED.with_(as_of=AS_OF)
# An event is worth about 10 and moves little, so thresholds are lower.
EVENT_PARAMS = USD.with_(as_of=datetime(2024, 2, 1), min_invested=Decimal("10"), min_return_pct=200.0)

# Declared, so that opening a table needs no look into its files.
TABLES = {
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_HOURLY = (
    "timestamp_ntz'2024-01-01' + interval '1' minute"
    " * (60 * datediff(l_shipdate, date'1995-01-01') + l_orderkey % 60)"
)
_INDEX = "l_orderkey * 8 + l_linenumber as trade_index"
_QUANTITY = "cast(l_quantity as decimal(18,2))"
_MONEY = "cast(l_extendedprice as decimal(18,2))"
_THOUSANDTH = f"cast({_MONEY} * 0.001 as decimal(28,9))"
_LAUNCH = "timestamp_ntz'2024-01-01' + interval '1' day * p_size"
_PROGRAM = (
    "case p_type " + " ".join(f"when '{kind}' then '{program}'" for kind, program in zip(PART_TYPES, PROGRAMS))
    + " else p_type end"
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def _signed(items: DataFrame, time: str, amount: str, price: str) -> DataFrame:
    return items.selectExpr(
        "'solana' as blockchain",
        "cast(l_partkey as string) as token_address",
        "cast(l_suppkey as string) as trader",
        f"if(l_linestatus = 'O', {_QUANTITY}, -{_QUANTITY}) as token_amount",
        f"{amount} as usd_amount",
        f"{price} as token_price",
        "concat_ws('-', l_orderkey, l_linenumber) as tx_id",
        f"{time} as block_time",
        _INDEX,
    )


def trades_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(load(spark, sf_dir, "lineitem"), "l_shipdate", _MONEY, "l_extendedprice / l_quantity")


def trades_signed_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    return _signed(items, _HOURLY, _THOUSANDTH, "l_extendedprice / l_quantity / 1000")


def trades_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_partkey as string) as token_mint_address",
        "cast(l_suppkey as string) as trader_wallet",
        "if(l_linestatus = 'O', 'buy', 'sell') as instruction_name",
        f"{_THOUSANDTH} as sol_amount",
        f"{_QUANTITY} as token_amount",
        "l_extendedprice / l_quantity / 1000 as price_per_token",
        f"{_HOURLY} as block_time",
        _INDEX,
    )


def _rows_of_parts(spark: SparkSession, sf_dir: str, columns: list[str], *rows: tuple[str, tuple[str, ...]]) -> DataFrame:
    """Several rows per part, each under a condition."""

    def struct(values: tuple[str, ...]) -> str:
        return "struct(" + ", ".join(f"{v} as {name}" for name, v in zip(columns, values)) + ")"

    each = ", ".join(f"if({condition}, {struct(values)}, null)" for condition, values in rows)
    return load(spark, sf_dir, "part").selectExpr(f"inline(array_compact(array({each})))")


def activity_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One creation per part, one later creation for LARGE parts, one repeated row for Brand#1, and mint rows."""

    def row(shift: str, instruction: str) -> tuple[str, ...]:
        return "cast(p_partkey as string)", f"{_LAUNCH} {shift}", "p_brand", _PROGRAM, f"'{instruction}'"

    return _rows_of_parts(
        spark,
        sf_dir,
        ["token_mint_address", "block_time", "creator_wallet", "account", "instruction_name"],
        ("true", row("", "create_token")),
        ("p_type = 'LARGE'", row("+ interval 240 hours", "create_token")),
        ("p_brand = 'Brand#1'", row("", "create_token")),
        ("true", row("- interval 5 hours", "mint_to")),
    )


def activity_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part, a later one for LARGE parts, a second owner for Brand#1, no mint for Brand#2."""

    def row(prefix, shift="", mint="cast(p_partkey as string)", owner="p_brand") -> tuple[str, ...]:
        return f"concat('{prefix}', p_partkey)", f"{_LAUNCH} {shift}", mint, owner, _PROGRAM

    return _rows_of_parts(
        spark,
        sf_dir,
        ["tx_id", "block_time", "account_mint", "account_owner", "account_program"],
        ("true", row("a")),
        ("p_type = 'LARGE'", row("b", shift="+ interval 36 hours")),
        ("p_brand = 'Brand#1'", row("c", owner="concat('co-', p_brand)")),
        ("p_brand = 'Brand#2'", row("d", mint="cast(null as string)")),
    )


def instruction_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the fallback program by STANDARD parts (twice) and LARGE parts, other calls by ECONOMY parts."""

    def row(executor: str) -> tuple[str, ...]:
        return "concat('a', p_partkey)", _LAUNCH, f"'{executor}'"

    return _rows_of_parts(
        spark,
        sf_dir,
        ["tx_id", "block_time", "executing_account"],
        ("p_type in ('STANDARD', 'LARGE')", row(FALLBACK_PROGRAM)),
        ("p_type = 'STANDARD'", row(FALLBACK_PROGRAM)),
        ("p_type = 'ECONOMY'", row("vote")),
    )


def trades_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks as signed trades with a trade id, for the incremental jobs.

    Events of other types (views, signups and the like) are no trades.
    """
    quantity = "cast(event_id % 7 + 1 as decimal(18,2))"
    return (
        load(spark, sf_dir, "events")
        .where("event_type in ('purchase', 'click')")
        .selectExpr(
            "'solana' as blockchain",
            "cast(cast(get_json_object(props, '$.k') as int) % 10 as string) as token_address",
            "cast(user_id as string) as trader",
            f"if(event_type = 'purchase', {quantity}, -{quantity}) as token_amount",
            "cast(value as decimal(18,2)) as usd_amount",
            "value / (event_id % 7 + 1) as token_price",
            "cast(event_id as string) as tx_id",
            "ts as block_time",
            "event_id as trade_index",
        )
    )
