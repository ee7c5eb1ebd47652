"""Readers, and the two ways raw trades become canonical trades.

Canonical trade: token, wallet, side, quantity (> 0 for a real trade), amount
(paid or received), their signs, price, tx_id, position, block_time. ``amount``
keeps its sign, since the variants treat negative amounts differently. Signs are
those of the raw values: an amount below the last digit kept is no zero.
Amounts that do not fit become NULL; ``count_rejects`` counts them. ``position``
orders trades of one instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walletscope.functions.scalars import AMOUNT, instant
from walletscope.params import Params
from walletscope.sources.schemas import OPTIONAL

CHAIN = "solana"
DATE_COLUMN = "block_date"
FORMATS = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read one input. Columns outside ``schema`` are dropped, but for the date partition."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    if fmt in ("csv", "json"):
        reader = spark.read.schema(schema)
        return reader.csv(path, header=True) if fmt == "csv" else reader.json(path)
    raw = spark.read.format(fmt).load(path)
    kept = [_conform(raw, field) for field in schema.fields if field.name in raw.columns or field.name not in OPTIONAL]
    if DATE_COLUMN in raw.columns:
        kept.append(F.col(DATE_COLUMN))
    return raw.select(*kept)


def _conform(raw: DataFrame, field: T.StructField) -> Column:
    column = F.col(field.name)
    if raw.schema[field.name].dataType != field.dataType:
        column = column.try_cast(field.dataType)
    return column.alias(field.name)


def count_rejects(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: per column, how many present values do not fit the target type, or are no finite number."""

    def misfit(field: T.StructField) -> Column:
        kept = F.col(field.name).try_cast(field.dataType)
        fits = F.abs(kept) < F.lit(float("inf")) if isinstance(field.dataType, T.DoubleType) else kept.isNotNull()
        return F.col(field.name).isNotNull() & ~F.coalesce(fits, F.lit(False))

    return raw.agg(*[F.count_if(misfit(f)).alias(f.name) for f in schema.fields if f.name in raw.columns])


def within(df: DataFrame, params: Params, time_column: str = "block_time") -> DataFrame:
    """Rows of the history window: from its first midnight to ``as_of``; prunes date folders too."""
    return until(since(df, params.window_start, time_column), params, time_column)


def until(df: DataFrame, params: Params, time_column: str = "block_time") -> DataFrame:
    """Rows up to ``as_of``: nothing later may change a result."""
    if DATE_COLUMN in df.columns:
        df = df.where(F.col(DATE_COLUMN) <= F.lit(params.as_of.date()))
    return df.where(F.col(time_column) <= instant(params.as_of))


def since(df: DataFrame, start, time_column: str = "block_time") -> DataFrame:
    """Rows from ``start`` on; prunes date folders too where the table has them."""
    if DATE_COLUMN in df.columns:
        df = df.where(F.col(DATE_COLUMN) >= F.lit(start.date()))
    return df.where(F.col(time_column) >= instant(start))


def _price(column: str) -> Column:
    # NaN and infinity compare greater than every threshold, so they would invent gains.
    value = F.col(column).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value).alias("price")


def _sign(raw: Column, kept: Column) -> Column:
    """-1, 0 or 1 by the raw value; NULL for one that does not fit."""
    return F.when(kept.isNull(), None).when(raw > 0, 1).when(raw < 0, -1).otherwise(0).cast("tinyint")


def _position(raw: DataFrame, *identity: str) -> Column:
    """The place of a trade in the chain; without one a hash of the trade, which favours no price."""
    drawn = F.shiftrightunsigned(F.xxhash64(*identity), 1)
    known = F.coalesce("trade_index", drawn) if "trade_index" in raw.columns else drawn
    return known.alias("position")


def sided_trades(raw: DataFrame) -> DataFrame:
    """Trades that name their side. Sides other than buy and sell are kept."""
    quantity, amount = (F.col(c).try_cast(AMOUNT) for c in ("token_amount", "sol_amount"))
    return raw.select(
        F.col("token_mint_address").alias("token"),
        F.col("trader_wallet").alias("wallet"),
        F.col("instruction_name").alias("side"),
        quantity.alias("quantity"),
        amount.alias("amount"),
        _sign(F.col("token_amount"), quantity).alias("quantity_sign"),
        _sign(F.col("sol_amount"), amount).alias("amount_sign"),
        _price("price_per_token"),
        F.lit(None).cast("string").alias("tx_id"),
        _position(raw, "trader_wallet", "instruction_name", "token_amount", "sol_amount", "price_per_token"),
        F.col("block_time"),
        *_date(raw),
    )


def signed_trades(raw: DataFrame) -> DataFrame:
    """Trades whose token amount carries the side as its sign; one chain only."""
    quantity, amount = (F.col(c).try_cast(AMOUNT) for c in ("token_amount", "usd_amount"))
    return raw.where((F.col("blockchain") == CHAIN) & F.col("token_address").isNotNull()).select(
        F.col("token_address").alias("token"),
        F.col("trader").alias("wallet"),
        F.when(F.col("token_amount") > 0, "buy").otherwise("sell").alias("side"),
        F.abs(quantity).alias("quantity"),
        amount.alias("amount"),
        _sign(F.col("token_amount"), quantity).alias("quantity_sign"),
        _sign(F.col("usd_amount"), amount).alias("amount_sign"),
        _price("token_price"),
        F.col("tx_id"),
        _position(raw, "tx_id", "trader", "token_amount", "usd_amount", "token_price"),
        F.col("block_time"),
        *_date(raw),
    )


def _date(raw: DataFrame) -> list[Column]:
    return [F.col(DATE_COLUMN)] if DATE_COLUMN in raw.columns else []
