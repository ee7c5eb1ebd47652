"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Each query runs once to warm up and then BENCH_RUNS times (default 2); the
median counts. A run builds the query from the raw tables and writes every row
of the result to a sink that discards it. ``stored_...`` are the roll-ups over
positions that ``store_positions`` wrote once, as they run in production.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from walletscope.plans import registry, rollups
from walletscope.plans.registry import QUERIES
from walletscope.session import build_session, new_folder, release
from walletscope.sources import adapters as A
from walletscope.sources import sinks

HEADLINE = (
    "moonshots_usd",
    "moonshots_sided",
    "moonshots_main",
    "positions_sided_event",
    "positions_normalized_event",
    "recent_tokens",
    "launches_wide",
    "latest_price_usd",
    "trades_normalized",
    "wallet_moonshots",
    "token_moonshots",
    "repeat_winners",
    "wallet_summary",
    "launchpad_comparison",
    "token_success",
    "weekly_trends",
    "trader_categories",
    "launchpad_volume",
    "top_wallets",
    "activity_spikes",
    "filter_positions",
    "drill_wallet",
    "export_csv",
    "stream_positions",
    "stream_spikes",
)
ROLLUPS = {
    "wallet_moonshots": rollups.wallet_moonshots,
    "wallet_summary": rollups.wallet_summary,
    "token_success": rollups.token_success,
    "weekly_trends": rollups.weekly_trends,
    "trader_categories": rollups.trader_categories,
    "top_wallets": rollups.top_wallets,
    "launchpad_comparison": lambda returns, params: rollups.launchpad_comparison(returns),
}


def runs_of(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    runs = {name: lambda name=name: QUERIES[name](spark, sf_dir) for name in HEADLINE}
    path = new_folder(spark, "bench-positions")

    def store() -> DataFrame:
        return sinks.write_positions(registry.normalized(spark, sf_dir).returns, path, mode="overwrite")

    runs["store_positions"] = store
    for name, rollup in ROLLUPS.items():
        runs[f"stored_{name}"] = lambda rollup=rollup: rollup(spark.read.parquet(path), A.NORMALIZED_PARAMS)
    return runs


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(build: Callable[[], DataFrame]) -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    runs, times = runs_of(spark, sf_dir), {}
    wanted = sys.argv[1:] or list(runs)
    if any(name.startswith("stored_") for name in wanted) and "store_positions" not in wanted:
        runs["store_positions"]()
    for name in wanted:
        timed(runs[name])
        times[name] = round(statistics.median(timed(runs[name]) for _ in range(repeats)), 3)
    release(spark)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
