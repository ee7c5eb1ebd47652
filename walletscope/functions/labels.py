"""Classifiers: a value falls on the first rung it reaches.

The thresholds and label texts are fixed values that consumers compare by text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Launch programs by account address.
PROGRAMS = {
    "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P": "pump.fun",
    "3xxDCjN8s6MgNHwdRD6Cgg3kHunJVu2SXBpkDbF9rJ9": "letsbonk",
    "7YttLkHDoNj9wyDur5pM1ejNaAvT9X4eqaYcHQqtj2G5": "bags",
}
FALLBACK_PROGRAM = "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P"
OTHER_LAUNCHPAD = "other"

# Fixed values: (lower bound, label), best first, then the label below every bound.
RETURN_TIER = (
    (10000, "100x+ (10000%+)"),
    (5000, "50-99x (5000-9999%)"),
    (2000, "20-49x (2000-4999%)"),
    (1000, "10-19x (1000-1999%)"),
)
RETURN_TIER_BELOW = "Under 10x"

RETURN_BAND = (
    (10000, "10000%+ (100x)"),
    (5000, "5000-9999% (50-99x)"),
    (2000, "2000-4999% (20-49x)"),
    (1000, "1000-1999% (10-19x)"),
)
RETURN_BAND_BELOW = "<1000%"

WALLET_TYPE = (
    (10, "Serial Moonshotter (10+)"),
    (5, "Frequent Moonshotter (5-9)"),
    (3, "Regular Moonshotter (3-4)"),
    (2, "Occasional Moonshotter (2)"),
)
WALLET_TYPE_BELOW = "One-Hit Wonder (1)"

SIZE_CLASS = (
    (100, "Whale (100+ SOL)"),
    (10, "Big Fish (10-100 SOL)"),
    (1, "Regular (1-10 SOL)"),
)
SIZE_CLASS_BELOW = "Small Fish (<1 SOL)"

# Fixed values: (upper bound in hours, label), shortest first, then the label above every bound.
ENTRY_TIMING = (
    (1, "Lightning Fast (<1h)"),
    (6, "Very Early (1-6h)"),
    (24, "Early (6-24h)"),
    (168, "Within Week (1-7d)"),
)
ENTRY_TIMING_ABOVE = "Late Entry (>7d)"

HOLD_STRATEGY = (
    (1, "Scalp (<1h)"),
    (24, "Day Trade (1-24h)"),
    (168, "Swing (1-7d)"),
    (720, "Position (1-4w)"),
)
HOLD_STRATEGY_ABOVE = "Long Hold (>4w)"

# Fixed values: (return %, number of traders at or above it, label), best first.
TOKEN_SUCCESS = (
    (10000, 5, "Ultra Success"),
    (5000, 10, "High Success"),
    (1000, 20, "Good Success"),
    (1000, 5, "Moderate Success"),
)
TOKEN_SUCCESS_BELOW = "Low Success"


def first_match(rungs: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    (condition, label), *rest = rungs
    chain = F.when(condition, label)
    for condition, label in rest:
        chain = chain.when(condition, label)
    return chain.otherwise(otherwise)


def _at_least(value: Column | str, rungs, below: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return first_match([(value >= bound, label) for bound, label in rungs], below)


def _at_most(value: Column | str, rungs, above: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return first_match([(value <= bound, label) for bound, label in rungs], above)


def return_tier(return_pct: Column | str) -> Column:
    return _at_least(return_pct, RETURN_TIER, RETURN_TIER_BELOW)


def return_band(return_pct: Column | str) -> Column:
    return _at_least(return_pct, RETURN_BAND, RETURN_BAND_BELOW)


def wallet_type(moonshots: Column | str) -> Column:
    return _at_least(moonshots, WALLET_TYPE, WALLET_TYPE_BELOW)


def size_class(invested: Column | str) -> Column:
    return _at_least(invested, SIZE_CLASS, SIZE_CLASS_BELOW)


def size_rank(label: Column | str) -> Column:
    """Position of a size class, largest first, for sorting by class."""
    label = F.col(label) if isinstance(label, str) else label
    names = [name for _, name in SIZE_CLASS] + [SIZE_CLASS_BELOW]
    return F.array_position(F.array(*map(F.lit, names)), label)


def entry_timing(hours: Column | str) -> Column:
    return _at_most(hours, ENTRY_TIMING, ENTRY_TIMING_ABOVE)


def hold_strategy(hours: Column | str) -> Column:
    return _at_most(hours, HOLD_STRATEGY, HOLD_STRATEGY_ABOVE)


def token_success(counts: dict[int, Column]) -> Column:
    """``counts`` maps a return threshold to the number of traders reaching it."""
    rungs = [(counts[pct] >= traders, label) for pct, traders, label in TOKEN_SUCCESS]
    return first_match(rungs, TOKEN_SUCCESS_BELOW)


def launchpad_of(program: Column | str) -> Column:
    program = F.col(program) if isinstance(program, str) else program
    pairs = [F.lit(text) for pair in PROGRAMS.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), program), F.lit(OTHER_LAUNCHPAD))
