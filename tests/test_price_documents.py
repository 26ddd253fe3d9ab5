"""Price documents made of line items against the weekly bars of the same line items."""

import datetime

from pyspark.sql import functions as F

from tallywick import adapters
from tallywick.sources import documents

LINE = adapters.TABLES["lineitem"]


def _tables(spark, folder):
    day = datetime.datetime(1995, 12, 20)
    rows = [
        (i, 1, None if i % 11 == 0 else i % 3, 1, float(i % 7), 100.25 + i * 37 % 90, 0.0, 0.0, (None, "A", "N", "R", "", "X")[i % 6], "O",
         None if i % 17 == 0 else day + datetime.timedelta(days=i % 40))
        for i in range(600)
    ]
    spark.createDataFrame(rows, LINE).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _plain(bars):
    return sorted(map(str, bars.select("asset", F.col("ts").cast("date"), "open", "high", "low", "close", "volume", "trades").collect()))


def test_documents_hold_the_weekly_bars(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    docs = adapters.ohlc_documents(spark, sf)
    assert _plain(documents.ohlc_bars(docs)) == _plain(adapters.weekly_bars(spark, sf).where("asset IS NOT NULL AND ts IS NOT NULL"))


def test_suppliers_line_items_move_once_as_numbers(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    moved = [line for line in adapters.ohlc_documents(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert sum("l_suppkey" in line for line in moved) == 1
    # what else moves are the three large assets, added up before
    assert len(moved) == 3


def test_documents_of_a_year(spark, tmp_path):
    docs = adapters.dated_ohlc_documents(spark, _tables(spark, tmp_path))
    in_year = docs.where("year = 1996 AND value IS NOT NULL").select("value")
    assert 0 < in_year.count() < docs.count()
    assert {r[0] for r in documents.ohlc_bars(in_year).select(F.year("ts")).distinct().collect()} == {1996}
