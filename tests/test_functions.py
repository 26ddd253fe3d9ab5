import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallywick.domains import AGE_RANGES
from tallywick.functions.ages import age_in, age_range
from tallywick.functions.prices import current_ticker, history_tier, overall_title
from tallywick.functions.text import dollars, pair_display_name, pair_key, without_blanks
from tallywick.functions.times import epoch_to_est, epoch_to_utc, in_zone, iso_date, iso_timestamp, weeks_before

AGES = {
    0: "<1", 1: "1-9", 9: "1-9", 10: "10-19", 19: "10-19", 20: "20-29", 29: "20-29", 35: "30-39", 49: "40-49",
    50: "50-59", 69: "60-69", 70: "70+", 554: "70+", 555: None, 998: None, 999: "Unknown", 1000: None, -1: None,
    None: None,
}


def values(spark, schema, rows, *columns):
    return [tuple(row) for row in spark.createDataFrame([(r,) for r in rows], schema).select(*columns).collect()]


def test_age_bins(spark):
    got = values(spark, "age int", list(AGES), F.col("age"), age_range(F.col("age")))
    assert dict(got) == AGES


def test_fractional_age_below_one_counts_in_the_first_years(spark):
    assert values(spark, "age double", [0.5, 9.9], age_range(F.col("age"))) == [("1-9",), ("1-9",)]


@settings(max_examples=8, deadline=None)
@given(st.sets(st.sampled_from(AGE_RANGES + ("no such range",))))
def test_age_predicate_equals_the_label(spark, chosen):
    df = spark.createDataFrame([(a,) for a in AGES], "age int")
    by_range = {r.age for r in df.filter(age_in(F.col("age"), chosen)).collect()}
    by_label = {r.age for r in df.filter(age_range(F.col("age")).isin(*chosen)).collect()}
    assert by_range == by_label == {a for a, label in AGES.items() if label in chosen}


def test_tiers(spark):
    weeks = [74, 75, 76, 99, 100, 101, 199, 200, 201]
    strict = [t for (t,) in values(spark, "n int", weeks, history_tier(F.col("n"), strict=True))]
    assert strict == ["overall", None, "50", "50", None, "100", "100", "200", None]
    closed = [t for (t,) in values(spark, "n int", weeks, history_tier(F.col("n")))]
    assert closed == ["overall", "50", "50", "50", "100", "100", "100", "200", "200"]


def test_tickers_and_titles(spark):
    got = values(spark, "b string", ["XXBT", "XETH", "XLTC", None], current_ticker(F.col("b")))
    assert got == [("BTC",), ("ETH",), ("XLTC",), (None,)]
    assert values(spark, "n bigint", [150], overall_title(F.col("n"))) == [("150 Week Average",)]


def test_pair_names(spark):
    keys = ["XXBTZUSD", "USDCUSD", "SOLEUR", "A.USD"]
    names = values(spark, "k string", keys, pair_display_name(F.col("k")), pair_key(pair_display_name(F.col("k"))))
    assert names == [
        ("XXBTZ USD", "XXBTZUSD"), (" USDCUSD", "USDCUSD"), ("SOLEUR", "SOLEUR"), ("A. USD", "A.USD"),
    ]
    assert values(spark, "k string", [" USDC USD"], pair_key(F.col("k"))) == [("USDCUSD",)]


def test_blanks_and_dollars(spark):
    assert values(spark, "t string", [" 0 1 0", "01"], without_blanks(F.col("t"))) == [("010",), ("01",)]
    amounts = [1.5, 2.0, 100.0, 12345678.9, 0.00005, 1e15, 0.1, None]
    texts = ["$1.5", "$2", "$100", "$12345678.9", "$0.0001", "$1000000000000000", "$0.1", None]
    assert [t for (t,) in values(spark, "x double", amounts, dollars(F.col("x"), 4))] == texts


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 4 July 2022, when summer time is in force elsewhere
        (got,) = values(spark, "e bigint", [1656892800], epoch_to_utc(F.col("e")), epoch_to_est(F.col("e")))
        assert got == (dt.datetime(2022, 7, 4), dt.datetime(2022, 7, 3, 19))
        texts = ["2013-04-28T00:00:00.000Z", "2013-04-28", "not a date", None]
        assert [d for (d,) in values(spark, "t string", texts, iso_date(F.col("t")))] == [
            dt.date(2013, 4, 28), dt.date(2013, 4, 28), None, None,
        ]
        stamps = ["2022-09-02T12:34:56.000Z", "2022-09-02 12:34:56", "2022-13-02T12:34:56.000Z", None]
        assert [t for (t,) in values(spark, "t string", stamps, iso_timestamp(F.col("t")))] == [
            dt.datetime(2022, 9, 2, 12, 34, 56), None, None, None,
        ]
        now = F.lit("2022-09-02 00:00:00").cast("timestamp_ntz")
        (row,) = values(spark, "x int", [1], weeks_before(now, 200), in_zone(now, "Etc/GMT+6"))
        assert row == (dt.datetime(2018, 11, 2), dt.datetime(2022, 9, 1, 18))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
