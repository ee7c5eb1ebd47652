"""Column helpers: exact rounding, exact means, whole hours, ISO weeks, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = T.DecimalType(28, 9)  # one trade amount; sums widen to DECIMAL(38,9)
RAW_AMOUNT = T.DecimalType(38, 18)  # as read, so that the sign of a tiny amount is not lost
_EXACT = T.DecimalType(38, 10)
_ROUNDING = T.DecimalType(38, 8)

ACCOUNT_URL = "https://solscan.io/account/"
TOKEN_URL = "https://solscan.io/token/"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def round_dec(value: Column | str, digits: int) -> Column:
    """Round half up to at most six digits, by way of DECIMAL.

    Eight digits first absorb the last-bit noise of a double, so 1.005 computed
    as 1.00499999 still rounds up. What DECIMAL cannot hold stays as it is.
    """
    value = _col(value)
    return F.coalesce(F.round(value.try_cast(_ROUNDING), digits).cast("double"), value.cast("double"))


def exact_sum(value: Column | str) -> Column:
    """Sum of doubles that does not depend on row order or partitioning.

    If a value or the total is beyond DECIMAL, it is the plain sum.
    """
    value = _col(value)
    exact = value.try_cast(_EXACT)
    held = F.when(F.count(exact) == F.count(value), F.try_sum(exact))
    return F.coalesce(held.cast("double"), F.sum(value))


def exact_avg(value: Column | str) -> Column:
    """Mean of doubles that does not depend on row order or partitioning."""
    return F.try_divide(exact_sum(value), F.count(_col(value)).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def whole_hours(start: Column | str, end: Column | str) -> Column:
    """Complete hours from start to end; 1 h 59 min is 1. Independent of the session zone."""
    return (_col(end) - _col(start)).cast("interval hour").cast("bigint")


def iso_week(moment: Column | str) -> Column:
    """Monday 00:00 of the week of a timestamp without zone."""
    moment = _col(moment)
    return F.date_sub(F.to_date(moment), F.weekday(moment)).cast("timestamp_ntz")


def instant(value) -> Column:
    """Literal timestamp without zone, so filters on it reach the file scan."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def account_link(wallet: Column | str) -> Column:
    return F.concat(F.lit(ACCOUNT_URL), _col(wallet))


def token_link(token: Column | str) -> Column:
    return F.concat(F.lit(TOKEN_URL), _col(token))
