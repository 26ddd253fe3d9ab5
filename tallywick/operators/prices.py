"""Weekly price histories: numbering, trailing averages, tables and chart series.

All assets are handled together, keyed by ``asset`` (never null). A history normally has at most 200 bars, but nothing
here relies on that: no window or join puts a whole asset into one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywick.domains import FIRST_OLDER_WEEK_50, FIRST_OLDER_WEEK_100, LOOKBACK_WEEKS
from tallywick.functions.prices import current_ticker, history_tier, overall_title
from tallywick.functions.text import dollars
from tallywick.functions.times import weeks_before
from tallywick.operators.numbering import numbered


def lookback(bars: DataFrame, as_of: Column, weeks: int = LOOKBACK_WEEKS) -> DataFrame:
    """Bars later than ``weeks`` weeks before ``as_of``."""
    start = weeks_before(as_of.cast("timestamp_ntz"), weeks).cast(bars.schema["ts"].dataType)
    return bars.filter(F.col("ts") > start)


def _time_order(bars: DataFrame, in_order: Callable[[Column], Column]) -> list[Column]:
    return [in_order(F.col(name)) for name in ("ts", "close") if name in bars.columns]


def week_numbers(bars: DataFrame, newest_first: bool = True) -> DataFrame:
    """Adds ``week_number`` (1 = latest, or 1 = earliest) and ``week_count`` within each asset.

    Numbered year by year: bars are counted per asset and year, the counts of the preceding years give each
    year's starting number, and only one year of one asset (53 weekly bars) is ever sorted together. Bars
    of the same time are numbered by their close, so that a repeated task numbers them alike.
    """
    in_order = Column.desc_nulls_last if newest_first else Column.asc_nulls_last
    # bars without a time form a year of their own, numbered last
    dated = bars.withColumn("_year", F.coalesce(F.year("ts"), F.lit(0)))
    per_year = dated.groupBy("asset", "_year").agg(F.count(F.lit(1)).alias("_bars"))
    asset = Window.partitionBy("asset")
    before = asset.orderBy(in_order(F.nullif(F.col("_year"), F.lit(0)))).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_year.select(
        "asset",
        "_year",
        F.coalesce(F.sum("_bars").over(before), F.lit(0)).alias("_start"),
        F.sum("_bars").over(asset).alias("week_count"),
    )
    # numbered before they are joined, so that join and window share one partitioning
    within = Window.partitionBy("asset", "_year").orderBy(*_time_order(bars, in_order))
    numbered = dated.withColumn("_number", F.row_number().over(within))
    return numbered.join(starts, ["asset", "_year"]).select(
        *bars.columns, (F.col("_start") + F.col("_number")).alias("week_number"), "week_count"
    )


def bar_numbers(bars: DataFrame, newest_first: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """:func:`week_numbers` for bars of any width, single trades among them: ``bar_number`` and ``bar_count``.

    Bars are dealt to ranges of (asset, time) that hold about as many bars each, so an asset with a third of all
    bars spreads over a third of the tasks. ``ties`` names further columns that order bars of the same time.
    """
    in_order = Column.desc_nulls_last if newest_first else Column.asc_nulls_last
    order = _time_order(bars, in_order) + [in_order(F.col(name)) for name in ties]
    return numbered(bars, ["asset"], order, "bar_number", "bar_count")


def trailing_averages(bars: DataFrame) -> DataFrame:
    """Every bar with its number, flags and averages.

    ``flag_50`` marks the latest 50 bars and ``flag_100`` the latest 99 (the limit is "below 100"). The 50
    and 100 week averages are means within the bar's own flag group, so older bars carry the mean of the
    older bars; only the flagged value is reported later.
    """
    number = F.col("week_number")
    flags = week_numbers(bars).withColumns(
        {
            "flag_50": F.when(number < FIRST_OLDER_WEEK_50, 1).otherwise(0),
            "flag_100": F.when(number < FIRST_OLDER_WEEK_100, 1).otherwise(0),
        }
    )
    close = F.col("close")
    means = flags.groupBy("asset").agg(
        F.avg(close).alias("avg_overall"),
        *[
            F.avg(F.when(F.col(f"flag_{w}") == flag, close)).alias(f"_avg_{w}_{flag}")
            for w in (50, 100)
            for flag in (0, 1)
        ],
    )
    own = {
        f"avg_{w}": F.when(F.col(f"flag_{w}") == 1, F.col(f"_avg_{w}_1")).otherwise(F.col(f"_avg_{w}_0"))
        for w in (50, 100)
    }
    joined = flags.join(means, "asset").withColumns(own)
    return joined.select(*flags.columns, "avg_overall", "avg_50", "avg_100")


def latest_averages(bars: DataFrame, strict: bool = False) -> DataFrame:
    """One row per asset: history length, tier and the averages a report shows.

    The latest 99 bars are picked by a ranked window, which Spark cuts down to 99 per asset and task before
    the shuffle; the overall mean is an ordinary aggregate.
    """
    overall = bars.groupBy("asset").agg(
        F.count(F.lit(1)).alias("week_count"),
        F.avg("close").alias("avg_overall"),
        F.min("ts").alias("first_ts"),
    )
    newest = Window.partitionBy("asset").orderBy(*_time_order(bars, Column.desc_nulls_last))
    latest = bars.select("asset", "close", F.row_number().over(newest).alias("number")).filter(
        F.col("number") < FIRST_OLDER_WEEK_100
    )
    means = latest.groupBy("asset").agg(
        F.avg(F.when(F.col("number") < FIRST_OLDER_WEEK_50, F.col("close"))).alias("avg_50"),
        F.avg("close").alias("avg_100"),
    )
    return overall.join(means, "asset").withColumn("tier", history_tier(F.col("week_count"), strict))


def _shown(tier: Column, column: str) -> Column:
    """An average, or null where its tier does not report it."""
    tiers = {"avg_50": ("200", "100", "50"), "avg_100": ("200", "100")}[column]
    return F.when(tier.isin(*tiers), F.col(column)).alias(column)


def average_table(averages: DataFrame, pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """The table under the price chart, one row per asset with a tier.

    The pair's base code becomes the asset name (two legacy codes renamed) and finds the current price by
    ticker. A ticker listed twice gives two rows, one that is not listed a null price. ``overall_title``
    names the overall average after the number of weeks.
    """
    tier = F.col("tier")
    rows = averages.filter(tier.isNotNull()).select(
        F.col("asset").alias("asset_tick"),
        "week_count",
        _shown(tier, "avg_50"),
        _shown(tier, "avg_100"),
        "avg_overall",
        overall_title(F.col("week_count")).alias("overall_title"),
    )
    bases = pairs.select("asset_tick", current_ticker(F.col("base")).alias("asset"))
    prices = listings.select(F.col("ticker").alias("_ticker"), F.col("price").alias("current_price"))
    named = rows.join(bases, "asset_tick", "left").distinct()
    return named.join(prices, F.col("asset") == F.col("_ticker"), "left").drop("_ticker")


def average_chart_series(bars: DataFrame, averages: DataFrame) -> DataFrame:
    """Weekly closes with the horizontal levels of each asset's tier."""
    tier = F.col("tier")
    levels = averages.filter(tier.isNotNull()).select(
        "asset", "avg_overall", _shown(tier, "avg_100"), _shown(tier, "avg_50")
    )
    return bars.select("asset", "ts", "close").join(levels, "asset")


def average_chart_labels(averages: DataFrame) -> DataFrame:
    """The labels on the levels, placed at the asset's first bar: series name, level and dollar text."""
    tier = F.col("tier")
    shown = averages.filter(tier.isNotNull()).select(
        "asset",
        "first_ts",
        F.inline(
            F.array(
                F.struct(overall_title(F.col("week_count")).alias("series"), F.col("avg_overall").alias("level")),
                F.struct(F.lit("100 Week Average").alias("series"), _shown(tier, "avg_100").alias("level")),
                F.struct(F.lit("50 Week Average").alias("series"), _shown(tier, "avg_50").alias("level")),
            )
        ),
    )
    return shown.filter(F.col("level").isNotNull()).withColumn("label", dollars(F.col("level"), 2))
