"""Small inputs in the shape of the raw tables, and result comparison."""

from datetime import datetime, timedelta
from decimal import Decimal

from walletscope.functions.labels import PROGRAMS
from walletscope.sources import schemas as S

PUMP, BONK, BAGS = PROGRAMS
T0 = datetime(2024, 3, 1)
DATA = "/root/testdata/sf0.001"


def at(hours=0.0, minutes=0.0):
    return T0 + timedelta(hours=hours, minutes=minutes)


def dec(value):
    return None if value is None else Decimal(str(value))


def sided(spark, rows):
    """rows: (token, wallet, side, amount, quantity, price, time); a row's number is its position"""
    data = [(t, w, s, dec(a), dec(q), p, at, i) for i, (t, w, s, a, q, p, at) in enumerate(rows)]
    return spark.createDataFrame(data, S.TRADES_SIDED)


def signed(spark, rows, chain="solana"):
    """rows: (token, wallet, signed quantity, usd, price, time[, tx[, position]])"""
    data = []
    for number, (t, w, q, usd, p, when, *rest) in enumerate(rows):
        tx, place = (*rest, None, None)[:2]
        data.append((chain, t, w, dec(q), dec(usd), p, tx or f"tx{number}", when, place))
    return spark.createDataFrame(data, S.TRADES_SIGNED)


def narrow(spark, rows):
    """rows: (token, time, creator, program[, instruction])"""
    data = [(t, when, c, p, *(rest or ["create_token"])) for t, when, c, p, *rest in rows]
    return spark.createDataFrame(data, S.LAUNCH_ACTIVITY_NARROW)


def wide(spark, rows):
    return spark.createDataFrame(rows, S.LAUNCH_ACTIVITY_WIDE)


def calls(spark, rows):
    return spark.createDataFrame(rows, S.INSTRUCTION_CALLS)


def rows_of(df):
    """Rows as sorted tuples, columns by name."""
    names = sorted(df.columns)
    return sorted((tuple(row) for row in df.select(*names).collect()), key=sort_key)


def sort_key(row):
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def dicts(df):
    return [row.asDict() for row in df.collect()]
