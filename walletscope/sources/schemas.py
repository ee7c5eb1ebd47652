"""Schemas of the five inputs.

``trade_index`` is the place of a trade in the order of the chain; tables without it
are read as well.
"""

from pyspark.sql import types as T

from walletscope.functions.scalars import RAW_AMOUNT

_TEXT = T.StringType()
_TIME = T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LAUNCH_ACTIVITY_NARROW = _schema(
    token_mint_address=_TEXT, block_time=_TIME, creator_wallet=_TEXT, account=_TEXT, instruction_name=_TEXT
)
LAUNCH_ACTIVITY_WIDE = _schema(
    tx_id=_TEXT, block_time=_TIME, account_mint=_TEXT, account_owner=_TEXT, account_program=_TEXT
)
INSTRUCTION_CALLS = _schema(tx_id=_TEXT, block_time=_TIME, executing_account=_TEXT)
OPTIONAL = ("trade_index",)

TRADES_SIDED = _schema(
    token_mint_address=_TEXT,
    trader_wallet=_TEXT,
    instruction_name=_TEXT,
    sol_amount=RAW_AMOUNT,
    token_amount=RAW_AMOUNT,
    price_per_token=T.DoubleType(),
    block_time=_TIME,
    trade_index=T.LongType(),
)
TRADES_SIGNED = _schema(
    blockchain=_TEXT,
    token_address=_TEXT,
    trader=_TEXT,
    token_amount=RAW_AMOUNT,
    usd_amount=RAW_AMOUNT,
    token_price=T.DoubleType(),
    tx_id=_TEXT,
    block_time=_TIME,
    trade_index=T.LongType(),
)
