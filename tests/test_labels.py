import pytest
from pyspark.sql import functions as F

from walletscope.functions import labels as L
from walletscope.functions.scalars import iso_week, round_dec, whole_hours

CASES = [
    (L.return_tier, {999.99: "Under 10x", 1000: "10-19x (1000-1999%)", 1999.99: "10-19x (1000-1999%)",
                     2000: "20-49x (2000-4999%)", 4999.99: "20-49x (2000-4999%)", 5000: "50-99x (5000-9999%)",
                     9999.99: "50-99x (5000-9999%)", 10000: "100x+ (10000%+)"}),
    (L.return_band, {999.99: "<1000%", 1000: "1000-1999% (10-19x)", 2000: "2000-4999% (20-49x)",
                     5000: "5000-9999% (50-99x)", 10000: "10000%+ (100x)"}),
    (L.entry_timing, {0: "Lightning Fast (<1h)", 1: "Lightning Fast (<1h)", 2: "Very Early (1-6h)",
                      6: "Very Early (1-6h)", 7: "Early (6-24h)", 24: "Early (6-24h)", 25: "Within Week (1-7d)",
                      168: "Within Week (1-7d)", 169: "Late Entry (>7d)"}),
    (L.hold_strategy, {0: "Scalp (<1h)", 1: "Scalp (<1h)", 2: "Day Trade (1-24h)", 24: "Day Trade (1-24h)",
                       25: "Swing (1-7d)", 168: "Swing (1-7d)", 169: "Position (1-4w)", 720: "Position (1-4w)",
                       721: "Long Hold (>4w)"}),
    (L.wallet_type, {1: "One-Hit Wonder (1)", 2: "Occasional Moonshotter (2)", 3: "Regular Moonshotter (3-4)",
                     4: "Regular Moonshotter (3-4)", 5: "Frequent Moonshotter (5-9)",
                     9: "Frequent Moonshotter (5-9)", 10: "Serial Moonshotter (10+)"}),
    (L.size_class, {0.99: "Small Fish (<1 SOL)", 1: "Regular (1-10 SOL)", 9.99: "Regular (1-10 SOL)",
                    10: "Big Fish (10-100 SOL)", 99.99: "Big Fish (10-100 SOL)", 100: "Whale (100+ SOL)"}),
]


@pytest.mark.parametrize("classifier,cases", CASES, ids=[c.__name__ for c, _ in CASES])
def test_every_boundary(spark, classifier, cases):
    df = spark.createDataFrame([(float(v), want) for v, want in cases.items()], "v double, want string")
    assert df.where(classifier("v") != F.col("want")).count() == 0


def test_token_success_takes_the_first_tier_reached(spark):
    rows = [(5, 5, 5, "Ultra Success"), (10, 10, 4, "High Success"), (20, 9, 4, "Good Success"),
            (5, 0, 0, "Moderate Success"), (4, 4, 4, "Low Success")]
    df = spark.createDataFrame(rows, "a int, b int, c int, want string")
    label = L.token_success({1000: F.col("a"), 5000: F.col("b"), 10000: F.col("c")})
    assert df.where(label != F.col("want")).count() == 0


def test_size_classes_sort_from_large_to_small(spark):
    names = [n for _, n in L.SIZE_CLASS] + [L.SIZE_CLASS_BELOW]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n string").orderBy(L.size_rank("n"))
    assert [r.n for r in df.collect()] == names


def test_launchpads(spark):
    df = spark.createDataFrame([*L.PROGRAMS.items(), ("unknown", "other"), (None, "other")], "p string, want string")
    assert df.where(~L.launchpad_of("p").eqNullSafe(F.col("want"))).count() == 0


def test_hours_are_complete_and_weeks_start_on_monday(spark):
    row = spark.sql(
        "select timestamp_ntz'2024-03-10 00:59:00' a, timestamp_ntz'2024-03-10 01:01:00' b,"
        " timestamp_ntz'2024-03-10 02:58:00' c, timestamp_ntz'2024-03-10 23:59:00' sunday,"
        " timestamp_ntz'2024-03-11 00:00:00' monday"
    ).select(
        whole_hours("a", "b").alias("two_minutes"),
        whole_hours("a", "c").alias("almost_two"),
        whole_hours("c", "a").alias("backwards"),
        iso_week("sunday").cast("string").alias("w1"),
        iso_week("monday").cast("string").alias("w2"),
    ).first()
    assert (row.two_minutes, row.almost_two, row.backwards) == (0, 1, -1)
    assert (row.w1[:10], row.w2[:10]) == ("2024-03-04", "2024-03-11")


def test_hours_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 01:30:00' a, timestamp_ntz'2024-03-10 03:30:00' b")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:00 to 03:00 does not exist there
        assert df.select(whole_hours("a", "b")).first()[0] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rounding_is_decimal(spark):
    row = spark.sql("select 1.005D a, 2.5D b, -1.005D c").select(
        round_dec("a", 2).alias("a"), round_dec("b", 0).alias("b"), round_dec("c", 2).alias("c")
    ).first()
    assert tuple(row) == (1.01, 3.0, -1.01)
