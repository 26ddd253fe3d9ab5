"""The generated order tables in the shapes the library works on.

An order plays a case: its customer's nation and a digit are the county and the region the state. Some cases lack an
ID or a county name or share an ID, some IDs have no code or two, one county in four has two codes, one of them
without a boundary, and one boundary has no case. A line item plays a
trade: every trade counts for three assets (its return flag, its supplier, and both together), which gives
histories of every length, from three assets that hold a third of all trades each to many with few bars.
Texts in ``SQL`` run unchanged in Spark SQL and in other engines, so that the check of a query can start
from the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywick.domains import LOOKBACK_WEEKS
from tallywick.operators.prices import lookback
from tallywick.sources.boundaries import to_binary

SQL = {
    "incidents": """
SELECT CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN CAST(o_orderkey - 1 AS STRING)
    ELSE CAST(o_orderkey AS STRING) END AS ID,
  CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE n_name || ' "' || (o_custkey % 4) || '", ' || r_name END AS CNTYFIPS,
  r_name AS State,
  CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE 'Unknown' END AS Solved,
  CAST(year(o_orderdate) AS INT) AS Year,
  CAST(CASE o_orderkey % 103 WHEN 100 THEN 999 WHEN 101 THEN 600 ELSE o_orderkey % 103 END AS INT) AS VicAge,
  CASE o_orderkey % 5 WHEN 3 THEN 'Female' WHEN 4 THEN 'Unknown' ELSE 'Male' END AS VicSex,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'White' WHEN '2' THEN 'Black' WHEN '3' THEN 'Asian'
    WHEN '4' THEN 'American Indian or Alaskan Native' ELSE 'Unknown' END AS VicRace,
  CAST(o_orderkey % 3 AS INT) AS VicCount,
  CAST(CASE o_custkey % 97 WHEN 96 THEN 999 ELSE o_custkey % 97 END AS INT) AS OffAge,
  CASE o_custkey % 4 WHEN 2 THEN 'Female' WHEN 3 THEN 'Unknown' ELSE 'Male' END AS OffSex,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'White' WHEN 'FURNITURE' THEN 'Black' WHEN 'BUILDING' THEN 'Asian'
    WHEN 'AUTOMOBILE' THEN 'American Indian or Alaskan Native' ELSE 'Unknown' END AS OffRace,
  CASE o_orderkey % 19
    WHEN 0 THEN 'Handgun - pistol, revolver, etc' WHEN 1 THEN 'Knife or cutting instrument'
    WHEN 2 THEN 'Other or type unknown' WHEN 3 THEN 'Explosives'
    WHEN 4 THEN 'Blunt object - hammer, club, etc' WHEN 5 THEN 'Firearm, type not stated'
    WHEN 6 THEN 'Rifle' WHEN 7 THEN 'Shotgun' WHEN 8 THEN 'Personal weapons, includes beating'
    WHEN 9 THEN 'Strangulation - hanging' WHEN 10 THEN 'Pushed or thrown out window' WHEN 11 THEN 'Fire'
    WHEN 12 THEN 'Narcotics or drugs, sleeping pills' WHEN 13 THEN 'Drowning' WHEN 14 THEN 'Other gun'
    WHEN 15 THEN 'Asphyxiation - includes death by gas' WHEN 16 THEN 'Poison - does not include gas'
    WHEN 17 THEN 'Handgun - pistol, revolver, etc' ELSE 'Unlisted' END AS Weapon,
  lpad(CAST(n_nationkey * 10 + CASE WHEN o_custkey % 8 = 7 THEN 9 ELSE o_custkey % 4 END AS STRING), 5, '0') AS county_fips
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  JOIN {region} ON n_regionkey = r_regionkey""",
    "codes": """
SELECT CAST(o_orderkey AS STRING) AS ID,
  ' ' || substr(lpad(CAST(c_nationkey AS STRING), 5, '0'), 1, 2) || ' '
      || substr(lpad(CAST(c_nationkey AS STRING), 5, '0'), 3, 3) || ' ' AS CNTYFIPS
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
WHERE o_orderkey % 13 <> 0
UNION ALL SELECT CAST(o_orderkey AS STRING), '99 ' || lpad(CAST(o_orderkey % 7 AS STRING), 3, '0')
FROM {orders} WHERE o_orderkey % 17 = 0
UNION ALL SELECT NULL, '99 999' FROM {region}""",
    "counties": """
SELECT lpad(CAST(n_nationkey * 10 + k AS STRING), 5, '0') AS GEOID, lpad(CAST(n_regionkey AS STRING), 2, '0') AS STATEFP,
  'GEOM ' || n_name || ' ' || k AS geometry
FROM (SELECT *, 0 AS k FROM {nation} UNION ALL SELECT *, 1 FROM {nation} UNION ALL SELECT *, 2 FROM {nation}
  UNION ALL SELECT *, 9 FROM {nation}) n
UNION ALL SELECT '99999', '00', 'GEOM EMPTY'""",
    "states": """
SELECT r_name AS State_Name, lpad(CAST(r_regionkey AS STRING), 2, '0') AS st_fips, substr(r_name, 1, 2) AS Abbrev
FROM {region}""",
    "pairs": """
SELECT 'T' || s_suppkey || 'USD' AS asset_tick, 'T' || s_suppkey || 'USD' AS altname, 'T' || s_suppkey AS base
FROM {supplier}
UNION ALL SELECT 'T' || s_suppkey || 'AUSD', 'T' || s_suppkey || 'AUSD', 'T' || s_suppkey FROM {supplier}
UNION ALL SELECT 'T' || s_suppkey || 'NUSD', 'T' || s_suppkey || 'NUSD', 'T' || s_suppkey FROM {supplier}
UNION ALL SELECT 'T' || s_suppkey || 'XBT', 'T' || s_suppkey || 'XBT', 'T' || s_suppkey FROM {supplier}
UNION ALL SELECT 'T' || s_suppkey || 'USDT', 'T' || s_suppkey || 'USDT', 'T' || s_suppkey FROM {supplier}
UNION ALL SELECT 'USDC' || s_suppkey || 'USD', 'USDC' || s_suppkey || 'USD', 'USDC' FROM {supplier}
UNION ALL SELECT 'XXBTZUSD', 'XBTUSD', 'XXBT'
UNION ALL SELECT 'XETHZUSD', 'ETHUSD', 'XETH'
UNION ALL SELECT 'XLTCZUSD', 'LTCUSD', 'XLTC'""",
    "quotes": """
SELECT s_suppkey AS id, s_name AS coin,
  CASE s_suppkey WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' ELSE 'T' || CAST(s_suppkey AS STRING) END AS ticker,
  'slug-' || s_suppkey AS slug,
  abs(s_acctbal) / 7 AS price, abs(s_acctbal) * 1000 / 7 AS volume_24h, s_acctbal / 700 AS percent_change_1h,
  s_acctbal / 330 AS percent_change_24h, s_acctbal / 170 AS percent_change_7d, s_acctbal / 130 AS percent_change_30d,
  s_acctbal / 110 AS percent_change_60d, s_acctbal / 70 AS percent_change_90d,
  abs(s_acctbal) * 100000 / 7 AS market_cap, abs(s_acctbal) / 1100 AS market_cap_dominance,
  CASE WHEN s_nationkey = 0 THEN NULL ELSE abs(s_acctbal) * 10 END AS max_supply,
  abs(s_acctbal) * 2 AS circulating_supply, abs(s_acctbal) * 5 AS total_supply,
  '2013-04-28T00:00:00.000Z' AS date_added, '2022-09-02T12:34:56.000Z' AS last_updated
FROM {supplier}""",
}

# stated, so that opening a table reads no file
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz",
}
MAJOR_ASSET = {"A": "XXBTZUSD", "N": "XETHZUSD", "R": "XLTCZUSD"}
# a weekday times this plus the price orders a week's trades by day, then price
_DAY_STEP = 10**12


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shapes in ``SQL``."""
    text = SQL[name]
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents before they have a county code."""
    return shape(spark, sf_dir, "incidents").drop("county_fips")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coins with their tickers and rounded prices."""
    return shape(spark, sf_dir, "quotes").withColumn("price", F.round("price", 4))


def weekly_bars(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """Weekly bars of all assets over all line items, or over those shipped from the day ``since`` on.

    Open is the lowest price of the week's first trading day and close the highest of its last one: the
    first and the last place in the order by weekday, then price. One aggregate with partial results does,
    however many trades an asset has in a week. Prices are whole numbers, so that sums are exact and
    averages equal in any order of addition.
    """
    line = load(spark, sf_dir, "lineitem")
    if since is not None:
        line = line.where(F.col("l_shipdate") >= since)
    flag = F.col("l_returnflag")
    supplier = F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))
    assets = F.array(_major_asset(), F.concat(supplier, F.lit("USD")), F.concat(supplier, flag, F.lit("USD")))
    return _bars(_weekly(line, F.explode(assets).alias("asset")), "asset", "ts")


def _major_asset() -> Column:
    return F.coalesce(*[F.when(F.col("l_returnflag") == f, F.lit(asset)) for f, asset in MAJOR_ASSET.items()])


def _weekly(line: DataFrame, *keys: Column) -> DataFrame:
    """Line items with what :func:`_bars` takes, each as a week's only trade."""
    day, price = F.to_date("l_shipdate"), F.floor("l_extendedprice")
    place = F.weekday(day) * F.lit(_DAY_STEP) + price
    return line.select(
        *keys,
        F.trunc(day, "week").alias("ts"),
        place.alias("first"),
        price.alias("most"),
        price.alias("least"),
        place.alias("last"),
        F.col("l_quantity").alias("volume"),
        F.lit(1).cast("bigint").alias("trades"),
    )


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key of the rows of :func:`_weekly`, or of their merged rows."""
    return rows.groupBy(*keys).agg(
        F.min("first").alias("first"),
        F.max("most").alias("most"),
        F.min("least").alias("least"),
        F.max("last").alias("last"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
    )


def _bars(rows: DataFrame, *keys: str) -> DataFrame:
    """The bar of each key, of the rows of :func:`_weekly` or of their merged rows."""
    return _merged(rows, *keys).select(
        *keys,
        (F.col("first") % _DAY_STEP).cast("double").alias("open"),
        F.col("most").cast("double").alias("high"),
        F.col("least").cast("double").alias("low"),
        (F.col("last") % _DAY_STEP).cast("double").alias("close"),
        "volume",
        "trades",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a trade of one of three assets, which hold a third of them each."""
    return load(spark, sf_dir, "lineitem").select(
        _major_asset().alias("asset"),
        F.to_date("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("close"),
        "l_orderkey",
        "l_linenumber",
    )


def last_week(spark: SparkSession, sf_dir: str) -> Column:
    """The latest week of the line items, as a subquery."""
    week = F.trunc(F.to_date(F.max("l_shipdate")), "week")
    return load(spark, sf_dir, "lineitem").agg(week.alias("ts")).scalar()


def recent_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the 200 weeks up to the last one; older line items are not read."""
    since = F.max("l_shipdate").cast("date")
    # weeks begin on Mondays, so the first one in the range begins a week after its limit
    first = F.date_add(F.trunc(since, "week"), 7 - 7 * LOOKBACK_WEEKS).cast("timestamp_ntz")
    start = load(spark, sf_dir, "lineitem").agg(first.alias("first")).scalar()
    return lookback(weekly_bars(spark, sf_dir, start), last_week(spark, sf_dir), LOOKBACK_WEEKS)


def boundary_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A county boundary per customer: a square, for every third with a hole, for every seventh with an island."""
    customers = load(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("GEOID"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("STATEFP"),
        F.col("c_custkey").alias("key"),
    )

    def square(x: float, side: float) -> np.ndarray:
        return np.array([(x, 0), (x, side), (x + side, side), (x + side, 0), (x, 0)], float)

    def shape_of(key: int) -> bytes:
        side = 3 + key % 5
        outline = [square(key, side)] + ([square(key + 1, 1)[::-1] + [0, 1]] if key % 3 == 0 else [])
        return to_binary([outline] + ([[square(key + 20, 2)]] if key % 7 == 0 else []))

    def run(batches):
        for batch in batches:
            shapes = pa.array(map(shape_of, batch.column(2).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], shapes], names=["GEOID", "STATEFP", "geometry"])

    return customers.mapInArrow(run, "GEOID string, STATEFP string, geometry binary")


# --- documents ------------------------------------------------------------------------------------------


def ohlc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price document per asset and year, which holds 53 weekly bars at most."""
    return dated_ohlc_documents(spark, sf_dir).select("value")


def dated_ohlc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`ohlc_documents` with the ``year`` of each; a filter by it reads only that year's line items.

    Both assets of a supplier come from its line items, which move once, to the task that makes the supplier's
    documents of a year; it adds them up as they come, so it holds 53 weeks of each flag, however many they are. The
    three assets that hold most line items are added up before they move. (Suppliers' assets have names of their own,
    as no return flag begins with a digit.) Line items without a supplier have no document.
    """
    line = load(spark, sf_dir, "lineitem")
    week = F.year(F.trunc(F.to_date("l_shipdate"), "week")).alias("year")
    sold = line.where(F.col("l_suppkey").isNotNull()).select("l_suppkey", "l_returnflag", F.to_date("l_shipdate").alias("l_shipdate"), "l_extendedprice", "l_quantity", week)
    dealt = sold.repartition("l_suppkey", "year")
    # a row for the flag's asset, and one that the supplier's own asset adds up
    both = _weekly(dealt, F.col("l_suppkey"), F.col("year"), F.explode(F.array("l_returnflag", F.lit(""))).alias("flag"))
    asset = F.concat(F.lit("T"), F.col("l_suppkey").cast("string"), F.col("flag"), F.lit("USD"))
    suppliers = _documents(_bars(both, "l_suppkey", "year", "flag", "ts"), "l_suppkey", "year", "flag", asset=asset)
    major = _bars(_weekly(line, _major_asset().alias("asset")), "asset", "ts").withColumn("year", F.year("ts"))
    return suppliers.unionByName(_documents(major, "asset", "year", asset=F.col("asset")))


def _documents(bars: DataFrame, *keys: str, asset: Column) -> DataFrame:
    """``year, value``: a document per key, of the asset that the key tells."""
    # numbers until they are collected, as texts take several times their room
    figures = ("open", "high", "low", "close", "close", "volume", "trades")
    bar = F.struct((F.unix_date("ts").cast("bigint") * 86400).alias("second"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(figures)])
    collected = bars.groupBy(*keys).agg(F.collect_list(bar).alias("bars"), (F.max(F.unix_date("ts").cast("bigint")) * 86400).alias("last"))
    names = ("second", *(f"f{i}" for i in range(len(figures))))
    rows = F.to_json(F.transform("bars", lambda one: F.array(*[one[n].cast("string") for n in names])))
    text = F.concat(
        F.lit('{"error":[],"result":{"'), asset, F.lit('":'), rows, F.lit(',"last":'), F.col("last").cast("string"), F.lit("}}"),
    )
    return collected.select("year", text.alias("value"))


def pair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair document per pair."""
    pairs = shape(spark, sf_dir, "pairs")
    record = F.struct("altname", "base", F.lit("currency").alias("aclass_base"))
    one = F.create_map(F.col("asset_tick"), record)
    return pairs.select(
        F.to_json(F.struct(F.array().cast("array<string>").alias("error"), one.alias("result"))).alias("value")
    )


def listing_documents(spark: SparkSession, sf_dir: str, page: int = 100) -> DataFrame:
    """Listing documents of up to 100 coins, as the provider pages them."""
    quotes = shape(spark, sf_dir, "quotes")
    in_usd = [
        "price", "volume_24h", "percent_change_1h", "percent_change_24h", "percent_change_7d", "percent_change_30d",
        "percent_change_60d", "percent_change_90d", "market_cap", "market_cap_dominance", "last_updated",
    ]
    coin = F.struct(
        "id", F.col("coin").alias("name"), F.col("ticker").alias("symbol"), "slug", "date_added", "max_supply",
        "circulating_supply", "total_supply", F.struct(F.struct(*in_usd).alias("USD")).alias("quote"),
    )
    pages = quotes.groupBy(F.floor(F.col("id") / page).alias("page")).agg(F.collect_list(coin).alias("data"))
    return pages.select(F.to_json(F.struct("data")).alias("value"))
