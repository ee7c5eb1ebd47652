"""Token launches from decoded chain activity.

Both forms yield (token, launch_time, creator, launchpad_name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walletscope.functions.labels import FALLBACK_PROGRAM, PROGRAMS, launchpad_of
from walletscope.functions.scalars import iso_week
from walletscope.params import Params
from walletscope.sources.tables import within

CREATE = "create_token"


def launches_narrow(activity: DataFrame, params: Params) -> DataFrame:
    """Launches where each activity row names its instruction."""
    created = within(activity, params).where(
        F.col("account").isin(*PROGRAMS) & (F.col("instruction_name") == CREATE)
    )
    rows = created.select(
        F.col("token_mint_address").alias("token"),
        F.col("block_time").alias("launch_time"),
        F.col("creator_wallet").alias("creator"),
        launchpad_of("account").alias("launchpad_name"),
    )
    return _at_grain(rows, params)


def launches_wide(activity: DataFrame, calls: DataFrame, params: Params) -> DataFrame:
    """Launches where the program shows in the activity row or, failing that, in an instruction call.

    Rows naming a known program need no join, and of the calls only those of
    the fallback program matter, so the join is a semi join of the remaining
    activity with those calls.
    """
    recent = within(activity, params).where(F.col("account_mint").isNotNull())
    known = F.col("account_program").isin(*PROGRAMS)
    named = recent.where(known).withColumn("launchpad_name", launchpad_of("account_program"))
    fallback_calls = within(calls, params).where(F.col("executing_account") == FALLBACK_PROGRAM)
    called = (
        recent.where(~F.coalesce(known, F.lit(False)))
        .join(fallback_calls.select("tx_id", "block_time"), ["tx_id", "block_time"], "left_semi")
        .withColumn("launchpad_name", F.lit(PROGRAMS[FALLBACK_PROGRAM]))
    )
    columns = [
        F.col("account_mint").alias("token"),
        F.col("block_time").alias("launch_time"),
        F.col("account_owner").alias("creator"),
        F.col("launchpad_name"),
    ]
    return _at_grain(named.select(*columns).unionByName(called.select(*columns)).distinct(), params)


def _at_grain(rows: DataFrame, params: Params) -> DataFrame:
    if params.launch_grain == "event":
        return rows
    earliest = rows.groupBy("token").agg(F.min(F.struct("launch_time", "launchpad_name", "creator")).alias("_e"))
    return earliest.select("token", "_e.launch_time", "_e.creator", "_e.launchpad_name")


def launch_frequency(launches: DataFrame) -> DataFrame:
    """Tokens launched per launchpad and week."""
    return launches.groupBy("launchpad_name", iso_week("launch_time").alias("launch_week")).agg(
        F.countDistinct("token").alias("tokens_launched")
    )
