"""Typed query parameters.

One frozen object replaces the text parameters of a dashboard, so every run is
reproducible: "now" is the field ``as_of``, never the clock of the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, time, timedelta
from decimal import Decimal

MAX_LOOKBACK_DAYS = 365


@dataclass(frozen=True)
class Params:
    as_of: datetime = datetime(2025, 1, 1)
    lookback_days: int = 90
    trend_days: int = 60
    # what counts as a position, a successful position and a moonshot
    min_invested: Decimal = Decimal("0.05")
    base_min_return: float = 100.0
    min_return_pct: float = 1000.0
    row_limit: int = 500
    # group thresholds
    min_token_trades: int = 10
    min_moonshot_traders: int = 3
    min_unique_traders: int = 5
    min_wallet_moonshots: int = 1
    min_repeat_moonshots: int = 2
    # 'token': one launch per token (its earliest); 'event': every launch row counts
    launch_grain: str = "token"

    def __post_init__(self) -> None:
        if self.launch_grain not in ("token", "event"):
            raise ValueError(f"launch_grain must be 'token' or 'event', not {self.launch_grain!r}")
        if self.lookback_days < 0:
            raise ValueError("lookback_days must not be negative")

    @property
    def window_start(self) -> datetime:
        """First instant of the history window; windows begin at midnight."""
        return _midnight(self.as_of.date() - timedelta(days=self.lookback_days))

    @property
    def trend_start(self) -> datetime:
        return _midnight(self.as_of.date() - timedelta(days=self.trend_days))

    def with_(self, **changes: object) -> Params:
        return replace(self, **changes)


def _midnight(day: date) -> datetime:
    return datetime.combine(day, time())


# Defaults of the three position variants.
SIDED = Params(min_invested=Decimal("0.05"), row_limit=500)
NORMALIZED = Params(min_invested=Decimal("0.1"), row_limit=1000)
USD = Params(min_invested=Decimal("50"), row_limit=1000)
