"""JSON documents, landed as files, to tables.

A document is one response of the provider and one row of text; parsing and flattening are column
expressions, so documents spread over tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywick import schemas
from tallywick.functions.times import epoch_to_est, epoch_to_utc, iso_date, iso_timestamp


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One document per file, or with ``one_per_line`` per line of a file, in column ``value``."""
    return spark.read.text(path, wholetext=not one_per_line)


def pair_catalog(documents: DataFrame) -> DataFrame:
    """Tradable pairs whose alternative name contains ``USD``: ``(asset_tick, altname, base)``.

    Key and record of a pair come out of the same map entry, so they need no matching by position.
    """
    pairs = documents.select(F.from_json("value", schemas.PAIR_DOCUMENT).alias("doc")).select(
        F.explode("doc.result").alias("asset_tick", "pair")
    )
    return pairs.filter(F.col("pair.altname").contains("USD")).select("asset_tick", "pair.altname", "pair.base")


def ohlc_bars(documents: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Price bars ``(asset, ts, date_est, open, high, low, close, vwap, volume, trades)``, and what is ``carried`` along.

    Text prices become numbers, null where they are none. ``ts`` is the UTC wall clock and ``date_est`` the
    wall clock five hours behind it.
    """
    series = documents.select(*carried, F.from_json("value", schemas.OHLC_DOCUMENT).alias("doc")).select(
        *carried, F.explode("doc.result").alias("asset", "rows")
    )
    # beside the pairs, the result holds the number ``last``
    rows = series.filter(F.col("asset") != "last").select(
        *carried, "asset", F.explode(F.from_json("rows", schemas.OHLC_ROWS)).alias("row")
    )

    def field(i: int, kind: str = "double") -> Column:
        return F.get("row", F.lit(i)).try_cast(kind)

    epoch = F.substring(F.get("row", F.lit(0)), 1, 10).try_cast("bigint")
    return rows.select(
        "asset",
        epoch_to_utc(epoch).alias("ts"),
        epoch_to_est(epoch).alias("date_est"),
        *[field(i).alias(name) for i, name in enumerate(("open", "high", "low", "close", "vwap", "volume"), 1)],
        field(7, "bigint").alias("trades"),
        *carried,
    )


_SHARES = (
    "percent_change_1h",
    "percent_change_24h",
    "percent_change_7d",
    "percent_change_30d",
    "percent_change_60d",
    "percent_change_90d",
    "market_cap_dominance",
)


def listings(documents: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Market listings, one row per coin; prices to four digits, percentages as fractions to four digits.

    Columns of the documents that are ``carried`` along come last.
    """
    coins = documents.select(*carried, F.from_json("value", schemas.LISTINGS_DOCUMENT).alias("doc")).select(
        *carried, F.inline("doc.data")
    )
    usd = "quote.USD"
    return coins.select(
        "id",
        F.col("name").alias("coin"),
        F.col("symbol").alias("ticker"),
        "slug",
        iso_date(F.col("date_added")).alias("date_added"),
        "max_supply",
        "circulating_supply",
        "total_supply",
        F.round(f"{usd}.price", 4).alias("price"),
        F.col(f"{usd}.volume_24h").alias("volume_24h"),
        *[F.round(F.col(f"{usd}.{share}") / 100, 4).alias(share) for share in _SHARES],
        F.col(f"{usd}.market_cap").alias("market_cap"),
        iso_timestamp(F.col(f"{usd}.last_updated")).alias("last_updated"),
        *carried,
    )
