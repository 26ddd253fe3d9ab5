"""Pair choices and the market table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywick.domains import LISTINGS_FOR_MARKET
from tallywick.functions.text import dollars, pair_display_name, pair_key


def pair_choices(catalog: DataFrame) -> DataFrame:
    """Pairs to choose from: key, display name and the key recovered from that name.

    Keys containing ``USDT`` are left out.
    """
    names = catalog.filter(~F.col("asset_tick").contains("USDT")).select(
        "asset_tick", pair_display_name(F.col("asset_tick")).alias("display_name")
    )
    return names.withColumn("chosen_key", pair_key(F.col("display_name")))


def latest_listings(listings: DataFrame, n: int) -> DataFrame:
    """The first ``n`` listings, largest market value first."""
    return listings.orderBy(F.col("market_cap").desc_nulls_last(), "id").limit(n)


def market_table(listings: DataFrame, n: int = LISTINGS_FOR_MARKET) -> DataFrame:
    """The first ``n`` listings with the columns of the market page.

    ``volume_change_24h`` repeats the 24 hour price change, as the published table does.
    """
    return latest_listings(listings, n).select(
        "coin",
        "ticker",
        "price",
        F.round("volume_24h", 2).alias("volume_24h"),
        F.col("percent_change_24h").alias("volume_change_24h"),
        F.col("percent_change_1h").alias("pct_change_1h"),
        F.col("percent_change_24h").alias("pct_change_24h"),
        F.col("percent_change_7d").alias("pct_change_7d"),
        F.col("percent_change_30d").alias("pct_change_30d"),
        F.round("market_cap", 2).alias("market_cap"),
        "market_cap_dominance",
    )


def price_display(market: DataFrame) -> DataFrame:
    """Adds the price as dollar text."""
    return market.withColumn("price_text", dollars(F.col("price"), 4))
