"""Wallet and token performance analytics on Spark."""

from walletscope.params import NORMALIZED, SIDED, USD, Params

__all__ = ["NORMALIZED", "SIDED", "USD", "Params"]
