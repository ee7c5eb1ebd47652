"""The range-partitioned routes must equal the built-in functions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows_of
from walletscope.operators.joins import JoinLimits, fits_broadcast, join_by_key, null_safe_join, payload_bytes
from walletscope.operators.ordered import exact_quantile, numbered, ranked

SORT_MERGE = JoinLimits(broadcast_bytes=0)


def skewed(spark, n=3000, seed=1):
    """A third of the rows share one key and one value."""
    rng = random.Random(seed)
    rows = [
        (i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", 5.0 if i % 3 == 0 else rng.randrange(400) / 4.0)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(6)


def with_nulls(spark):
    """NULL keys and NULL metrics, and columns in an order of their own."""
    rows = [("w", None, "n", 1), ("m", 2.0, None, None), ("n", 2.0, "x", 3), (None, None, None, 3), ("q", -1.0, "n", 7)]
    return spark.createDataFrame(rows, "w string, m double, n string, r int")


def same(got, want):
    assert got.schema.simpleString() == want.schema.simpleString()
    key = lambda row: [(v is None, str(v)) for v in row]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_distributed_rank_equals_rank(spark):
    for df, metrics in ((skewed(spark), {"r": "v", "s": "id"}), (with_nulls(spark), {"a": "m", "b": "n", "c": "r"})):
        want = df.select(
            "*",
            *[F.rank().over(Window.orderBy(F.col(c).desc_nulls_last())).cast("bigint").alias(o) for o, c in metrics.items()],
        )
        same(ranked(df, metrics, single_task_rows=0), want)
        same(ranked(df, metrics), want)


def test_null_safe_join_keeps_order_and_null_keys(spark):
    df = with_nulls(spark)
    table = spark.createDataFrame([(None, 10), ("n", 20)], "n string, x int")
    got = null_safe_join(df, table, ["n"])
    assert got.columns == [*df.columns, "x"] and {(r.w, r.x) for r in got.collect()} == {("w", 20), ("m", 10), (None, 10), ("q", 20)}
    assert [r.w for r in null_safe_join(df, table, ["n"], "left_anti").collect()] == ["n"]


def test_rank_ties_share_a_rank_and_the_next_is_skipped(spark):
    df = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("c", 5.0)], "w string, p double")
    for rows in (0, 1000):
        got = {r.w: r.rank for r in ranked(df, {"rank": "p"}, single_task_rows=rows).collect()}
        assert got == {"a": 1, "b": 1, "c": 3}


@pytest.mark.parametrize("q", [0.5, 0.0, 0.37, 1.0])
def test_exact_quantile_equals_percentile(spark, q):
    df = skewed(spark)
    got = exact_quantile(df, ["k"], "v", "m", q)
    want = df.groupBy("k").agg(F.percentile("v", q).alias("m"))
    pairs = {r.k: r.m for r in got.collect()}, {r.k: r.m for r in want.collect()}
    assert pairs[0] == pytest.approx(pairs[1])


def test_median_of_an_even_count_lies_between(spark):
    df = spark.createDataFrame([("t", 1), ("t", 4)], "k string, h long")
    assert exact_quantile(df, ["k"], "h", "m").first().m == 2.5
    assert df.agg(F.percentile("h", 0.5)).first()[0] == 2.5


def test_quantiles_of_null_groups_and_null_values(spark):
    df = with_nulls(spark)
    same(exact_quantile(df, ["n"], "m", "q"), df.where("m IS NOT NULL").groupBy("n").agg(F.percentile("m", 0.5).alias("q")))


def test_row_numbers_of_large_groups_equal_row_number(spark):
    hot = skewed(spark).withColumn("k", F.when(F.col("k") != "hot", F.col("k")))  # the hot key is NULL
    for df in (skewed(spark), hot):
        order = [F.col("v").asc(), F.col("id").asc()]
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
        same(numbered(df, ["k"], order, "n", single_task_rows=50, most_groups=10), want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_routes_agree(spark, how):
    rows = skewed(spark)
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 60, 2)]], "k string, x int")
    want = rows.join(table, "k", how)
    assert rows_of(join_by_key(rows, table, ["k"], how)) == rows_of(want)
    assert rows_of(join_by_key(rows, table, ["k"], how, limits=SORT_MERGE)) == rows_of(want)


def test_a_large_table_is_merged_and_rows_are_read_once(spark):
    rows, table = skewed(spark), spark.createDataFrame([("hot", 1)], "k string, x int")
    plan = join_by_key(rows, table, ["k"], limits=SORT_MERGE)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "Union" not in plan


def test_size_check_measures_text(spark):
    small = spark.createDataFrame([("x" * 10, 1)], "k string, x int")
    assert payload_bytes(small) < payload_bytes(spark.createDataFrame([("x" * 1000, 1)], "k string, x int"))
    assert fits_broadcast(small) and not fits_broadcast(small, JoinLimits(broadcast_bytes=0))
    assert payload_bytes(small.where("false")) == 0
