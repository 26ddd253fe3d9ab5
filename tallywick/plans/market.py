"""The market run: landed listings in, market table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywick.domains import LISTINGS_FOR_MARKET
from tallywick.operators.market import market_table, price_display
from tallywick.sources.documents import listings, read_documents


def run_market(
    spark: SparkSession, path: str, n: int = LISTINGS_FOR_MARKET, one_per_line: bool = False
) -> DataFrame:
    """Market table with dollar prices from the listing documents below ``path``."""
    return price_display(market_table(listings(read_documents(spark, path, one_per_line)), n))
