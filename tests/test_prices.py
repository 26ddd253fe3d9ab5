import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallywick.operators import prices as p
from tallywick.plans.averages import run_averages

MONDAY = dt.date(2022, 8, 29)


def history(asset, n, seed=0):
    """``n`` weekly bars up to one Monday."""
    rng = random.Random(f"{asset}{seed}")
    return [(asset, MONDAY - dt.timedelta(weeks=i), float(rng.randint(1, 1000))) for i in range(n)]


def bars(spark, *histories):
    rows = [row for h in histories for row in h]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "asset string, ts date, close double")


def mean(values):
    return sum(values) / len(values)


LENGTHS = [74, 75, 76, 99, 100, 101, 199, 200, 201]


@pytest.fixture(scope="module")
def many(spark):
    return bars(spark, *[history(f"a{n}", n) for n in LENGTHS]).cache()


def closes(n):
    return [row[2] for row in history(f"a{n}", n)]  # latest first


def test_numbers_against_a_plain_sort(spark):
    rng = random.Random(3)
    rows = [
        (f"a{i % 3}", dt.date(2010, 1, 1) + dt.timedelta(days=d), 1.0)
        for i, d in enumerate(rng.sample(range(4000), 600))
    ]
    df = spark.createDataFrame(rows, "asset string, ts date, close double")
    for newest_first in (True, False):
        got = {(r.asset, r.ts): (r.week_number, r.week_count) for r in p.week_numbers(df, newest_first).collect()}
        want = {}
        for asset in ("a0", "a1", "a2"):
            days = sorted((r[1] for r in rows if r[0] == asset), reverse=newest_first)
            want |= {(asset, day): (i, len(days)) for i, day in enumerate(days, 1)}
        assert got == want


def test_bars_without_a_time_come_last(spark):
    df = spark.createDataFrame(
        [("a", None, 1.0), ("a", MONDAY, 2.0), ("a", dt.date(2000, 1, 3), 3.0)], "asset string, ts date, close double"
    )
    for newest_first, want in ((True, {2.0: 1, 3.0: 2, 1.0: 3}), (False, {3.0: 1, 2.0: 2, 1.0: 3})):
        assert {r.close: r.week_number for r in p.week_numbers(df, newest_first).collect()} == want


def test_equal_times_get_different_numbers(spark):
    df = spark.createDataFrame([("a", MONDAY, float(i)) for i in range(5)], "asset string, ts date, close double")
    assert {r.close: r.week_number for r in p.week_numbers(df).collect()} == {4.0: 1, 3.0: 2, 2.0: 3, 1.0: 4, 0.0: 5}


def test_equal_times_at_the_limit_are_told_apart_by_close(spark):
    """Fifty bars of one time and one more: the same fifty are taken wherever they are averaged."""
    rows = [("a", MONDAY, float(i)) for i in range(51)]
    df = spark.createDataFrame(rows, "asset string, ts date, close double").repartition(3)
    (row,) = p.latest_averages(df).collect()
    assert row.avg_50 == mean(range(1, 51))
    flagged = [r.close for r in p.trailing_averages(df).collect() if r.flag_50 == 1]
    assert sorted(flagged) == [float(i) for i in range(1, 51)]


def test_latest_averages(many):
    got = {r.asset: r for r in p.latest_averages(many, strict=True).collect()}
    for n in LENGTHS:
        row, close = got[f"a{n}"], closes(n)
        assert row.week_count == n and row.first_ts == MONDAY - dt.timedelta(weeks=n - 1)
        assert row.avg_overall == pytest.approx(mean(close))
        assert row.avg_50 == pytest.approx(mean(close[:50]))  # fifty bars
        assert row.avg_100 == pytest.approx(mean(close[:99]))  # ninety-nine bars
    tiers = {n: got[f"a{n}"].tier for n in LENGTHS}
    assert tiers == {74: "overall", 75: None, 76: "50", 99: "50", 100: None, 101: "100", 199: "100", 200: "200", 201: None}


def test_older_bars_carry_the_older_mean(many):
    close = closes(200)
    rows = {r.week_number: r for r in p.trailing_averages(many).filter("asset = 'a200'").collect()}
    assert len(rows) == 200
    assert [rows[i].flag_50 for i in (50, 51)] == [1, 0] and [rows[i].flag_100 for i in (99, 100)] == [1, 0]
    assert rows[50].avg_50 == pytest.approx(mean(close[:50])) and rows[51].avg_50 == pytest.approx(mean(close[50:]))
    assert rows[99].avg_100 == pytest.approx(mean(close[:99])) and rows[100].avg_100 == pytest.approx(mean(close[99:]))
    assert all(r.avg_overall == pytest.approx(mean(close)) for r in rows.values())


def test_missing_prices_are_left_out_of_means(spark):
    df = spark.createDataFrame([("a", MONDAY, None), ("a", dt.date(2022, 8, 22), 4.0)], "asset string, ts date, close double")
    (row,) = p.latest_averages(df).collect()
    assert (row.week_count, row.avg_overall, row.avg_50) == (2, 4.0, 4.0)


def test_one_asset_alone_equals_its_part(many):
    alone = p.latest_averages(many.filter("asset = 'a101'")).collect()
    assert alone == p.latest_averages(many).filter("asset = 'a101'").collect()


def test_lookback_is_open_at_its_start(spark):
    df = bars(spark, history("a", 210))
    assert p.lookback(df, F.lit(MONDAY)).count() == 200
    exact = p.lookback(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), F.lit("2022-08-29 00:00:00").cast("timestamp_ntz"))
    assert exact.count() == 200


PAIRS = [("a200", "XBTUSD", "XXBT"), ("a101", "ETHUSD", "XETH"), ("a76", "LTCUSD", "XLTC"), ("a74", "SOLUSD", "SOL")]
LISTINGS = [(1, "BTC", 20000.0, 9.0), (2, "ETH", 1500.0, 8.0), (3, "SOL", 30.0, 7.0), (4, "SOL", 0.5, 6.0), (5, "LTC", 50.0, 5.0)]


@pytest.fixture(scope="module")
def table(spark, many):
    pairs = spark.createDataFrame(PAIRS, "asset_tick string, altname string, base string")
    listings = spark.createDataFrame(LISTINGS, "id bigint, ticker string, price double, market_cap double")
    return run_averages(many, pairs, listings, F.lit(MONDAY))


def test_average_table(table):
    rows = {}
    for r in table["average_table"].collect():
        rows.setdefault(r.asset_tick, []).append(r)
    assert set(rows) == {f"a{n}" for n in LENGTHS}
    (btc,) = rows["a200"]
    assert (btc.asset, btc.current_price, btc.overall_title) == ("BTC", 20000.0, "200 Week Average")
    assert None not in (btc.avg_50, btc.avg_100, btc.avg_overall)
    (eth,) = rows["a101"]
    assert (eth.asset, eth.overall_title) == ("ETH", "101 Week Average")
    (ltc,) = rows["a76"]  # no current spelling known for this base
    assert (ltc.asset, ltc.current_price, ltc.avg_100) == ("XLTC", None, None) and ltc.avg_50 is not None
    assert sorted(r.current_price for r in rows["a74"]) == [0.5, 30.0]  # listed twice
    assert {(r.avg_50, r.avg_100) for r in rows["a74"]} == {(None, None)}
    assert rows["a99"][0].asset is None  # not among the pairs


def test_chart(table, many):
    series = table["chart_series"]
    assert series.filter("asset = 'a101'").count() == 101
    assert series.filter("asset = 'a76' AND avg_100 IS NOT NULL").count() == 0
    assert series.filter("asset = 'a100' AND avg_100 IS NOT NULL").count() == 100
    labels = {(r.asset, r.series): r for r in table["chart_labels"].collect()}
    assert {s for a, s in labels if a == "a101"} == {"101 Week Average", "100 Week Average", "50 Week Average"}
    assert {s for a, s in labels if a == "a74"} == {"74 Week Average"}
    row = labels["a74", "74 Week Average"]
    assert row.first_ts == MONDAY - dt.timedelta(weeks=73)
    assert row.label.startswith("$") and float(row.label[1:]) == pytest.approx(mean(closes(74)), abs=0.0051)


def test_closed_tiers(spark, many):
    tiers = {r.asset: r.tier for r in p.latest_averages(many).collect()}
    assert (tiers["a75"], tiers["a100"], tiers["a201"]) == ("50", "100", "200")
