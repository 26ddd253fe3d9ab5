"""The price averages run: landed documents in, average table and chart series out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tallywick.operators.market import latest_listings
from tallywick.operators.prices import (
    average_chart_labels,
    average_chart_series,
    average_table,
    latest_averages,
    lookback,
)


def run_averages(
    bars: DataFrame, pairs: DataFrame, listings: DataFrame, as_of: Column, strict: bool = False, listed: int | None = None
) -> dict[str, DataFrame]:
    """Average table, chart series and chart labels of every asset, as of one moment.

    Prices come from all listings, or from the ``listed`` largest if a number is given.
    """
    history = lookback(bars, as_of)
    averages = latest_averages(history, strict)
    return {
        "average_table": average_table(averages, pairs, listings if listed is None else latest_listings(listings, listed)),
        "chart_series": average_chart_series(history, averages),
        "chart_labels": average_chart_labels(averages),
    }
