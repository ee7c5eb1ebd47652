"""Operators that need a total order, without moving all rows to one task.

Ranks, exact medians and row numbers rest on one building block: split the
rows by value range, count inside each range, and add what the ranges before
hold. Only one row per range (never the data) meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.operators.joins import null_safe_join
from walletscope.session import materialize

# Up to this many (counted) rows a single task may sort them all. Both routes give the same rows and columns.
SINGLE_TASK_ROWS = 1_000_000
ROWS_A_RANGE = 2_000_000


def _ranges(df: DataFrame) -> int:
    """How many ranges: as many as shuffles have partitions, more for a large (stored) table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_RANGE))


def running_total(df: DataFrame, order: list[Column], weight: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows ordered before the row.

    Rows must differ in their order key. The range split is written out, so a
    retried task sees the same ranges.
    """
    df = materialize(df, "unordered")
    spread = df.repartitionByRange(_ranges(df), *order)
    ranges = materialize(spread.withColumn("_range", F.spark_partition_id()), "ranges")
    earlier_rows = (Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(F.sum(weight).alias("_total"))
    offsets = totals.select(
        "_range",
        F.coalesce(
            F.sum("_total").over(Window.orderBy("_range").rowsBetween(*earlier_rows)), F.lit(0)
        ).alias("_offset"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(*earlier_rows)
    return (
        ranges.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_range")  # one row per range
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_range", "_inside", "_offset")
    )


def ranked(
    df: DataFrame,
    metrics: dict[str, str],
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Add competition ranks: ``metrics`` maps an output name to the column ranked descending.

    Equal values share a rank and the next value skips accordingly; NULLs share
    the last one. ``df`` is written out once, since it is read per metric.
    """
    df = materialize(df, "unranked")
    if df.count() <= single_task_rows:
        ranks = [
            F.rank().over(Window.orderBy(F.col(column).desc_nulls_last())).cast("bigint").alias(out)
            for out, column in metrics.items()
        ]
        return df.select("*", *ranks)
    for out, column in metrics.items():
        # Ranking distinct values keeps ties together however often a value occurs.
        values = df.groupBy(column).agg(F.count("*").alias("_rows"))
        placed = running_total(values, [F.col(column).desc_nulls_last()], "_rows", "_before")
        ranks = placed.select(column, (F.col("_before") + 1).alias(out))
        df = null_safe_join(df, ranks, [column])
    return df


def exact_quantile(df: DataFrame, keys: list[str], value: str, out: str, q: float = 0.5) -> DataFrame:
    """Interpolated quantile per group, for groups too large for one task's memory.

    Groups with NULL keys count, NULL values do not, as in the built-in function.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_rows"))
    placed = running_total(counts, [F.col(c).asc() for c in [*keys, value]], "_rows", "_before")
    groups = materialize(
        placed.groupBy(*keys).agg(F.min("_before").alias("_start"), F.sum("_rows").alias("_size")), "groups"
    )
    position = (F.col("_size") - 1) * F.lit(float(q))
    first = F.col("_before") - F.col("_start")

    def covers(target: Column) -> Column:
        return (first <= target) & (target < first + F.col("_rows"))

    placed = null_safe_join(placed, groups, keys)
    ends = placed.groupBy(*keys).agg(
        F.max(F.when(covers(F.floor(position)), F.col(value))).alias("_low"),
        F.max(F.when(covers(F.ceil(position)), F.col(value))).alias("_high"),
        F.max(position - F.floor(position)).alias("_share"),
    )
    low, high = F.col("_low"), F.col("_high")
    between = low * (F.lit(1.0) - F.col("_share")) + high * F.col("_share")
    return ends.select(*keys, F.when(low == high, low).otherwise(between).cast("double").alias(out))


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str,
    single_task_rows: int = SINGLE_TASK_ROWS,
    most_groups: int = 100_000,
) -> DataFrame:
    """Add row numbers per group; groups too large for one task are numbered range by range.

    Large means beyond ``single_task_rows`` and beyond 1/``most_groups`` of all
    rows, so at most ``most_groups`` groups are large and their table is small.
    ``df`` is written out once. Groups with NULL keys are groups like others.
    """
    df = materialize(df, "unnumbered")
    per_group = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    sizes = materialize(df.groupBy(*keys).agg(F.count("*").alias("_rows")), "group-sizes")
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    large = sizes.where(F.col("_rows") > max(single_task_rows, total // most_groups)).drop("_rows")
    if large.isEmpty():
        return df.withColumn(out, per_group)

    spread = null_safe_join(df, F.broadcast(large), keys, "left_semi").repartitionByRange(_ranges(df), *keys, *order)
    ranges = materialize(spread.withColumn("_range", F.spark_partition_id()), "ranges")
    pieces = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*keys, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    numbered_large = (
        null_safe_join(ranges.withColumn("_inside", inside), F.broadcast(offsets), [*keys, "_range"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_range", "_inside", "_offset")
    )
    rest = null_safe_join(df, F.broadcast(large), keys, "left_anti").withColumn(out, per_group)
    return rest.unionByName(numbered_large.select(*rest.columns))
