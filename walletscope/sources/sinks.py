"""Writers: date-partitioned trades, the positions table, CSV lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walletscope.sources.tables import DATE_COLUMN


def write_trades(trades: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Store raw trades by day (and e.g. by chain), so that windows prune folders.

    Rebalancing sizes the files and splits large days over several tasks.
    """
    folders = [*by, DATE_COLUMN]
    dated = trades.withColumn(DATE_COLUMN, F.to_date("block_time"))
    dated.hint("rebalance", *folders).write.partitionBy(*folders).parquet(path)


def write_positions(returns: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Store evaluated positions: the one table every roll-up and drill-down reads."""
    returns.write.mode(mode).parquet(path)
    return returns.sparkSession.read.schema(returns.schema).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Export a report or wallet list; part files, each with a header line."""
    df.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, header=True)
