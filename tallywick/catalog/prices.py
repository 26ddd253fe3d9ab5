"""Queries over price histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywick import adapters
from tallywick.catalog.registry import as_text, dollar_sql, query, rounded, sql
from tallywick.functions.times import in_zone
from tallywick.operators import prices
from tallywick.operators.quantiles import quantiles
from tallywick.plans.averages import run_averages
from tallywick.sources.tables import printed_average_table


QUANTILES = (0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)


def _closes(bars: DataFrame) -> DataFrame:
    return bars.select("asset", "ts", "close")


@query("lookback", sql("SELECT * REPLACE (CAST(ts AS VARCHAR) AS ts) FROM bars", "bars"))
def _(spark, sf):
    return as_text(adapters.recent_bars(spark, sf), "ts")


@query("week_numbers", sql("SELECT asset, CAST(ts AS VARCHAR) AS ts, close, week_number, week_count FROM all_numbered", "all_numbered"))
def _(spark, sf):
    return as_text(prices.week_numbers(_closes(adapters.weekly_bars(spark, sf))), "ts")


@query(
    "week_numbers_ascending",
    sql(
        """SELECT asset, CAST(ts AS VARCHAR) AS ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS week_number,
        count(*) OVER (PARTITION BY asset) AS week_count FROM all_bars""",
        "all_bars",
    ),
)
def _(spark, sf):
    bars = adapters.weekly_bars(spark, sf).select("asset", "ts")
    return as_text(prices.week_numbers(bars, newest_first=False), "ts")


@query(
    "trade_numbers",
    sql(
        """SELECT asset, CAST(ts AS VARCHAR) AS ts, close, l_orderkey, l_linenumber,
        row_number() OVER (PARTITION BY asset ORDER BY ts DESC, close DESC, l_orderkey DESC, l_linenumber DESC) AS bar_number,
        count(*) OVER (PARTITION BY asset) AS bar_count
        FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'XXBTZUSD' WHEN 'N' THEN 'XETHZUSD' WHEN 'R' THEN 'XLTCZUSD' END AS asset,
          CAST(l_shipdate AS DATE) AS ts, l_extendedprice AS close, l_orderkey, l_linenumber FROM lineitem) t"""
    ),
)
def _(spark, sf):
    """Every single trade numbered within its asset; three assets hold a third of all trades each."""
    numbered = prices.bar_numbers(adapters.trades(spark, sf), ties=("l_orderkey", "l_linenumber"))
    return as_text(numbered, "ts")


@query(
    "price_quantiles",
    " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem"
        for p in QUANTILES
    ),
)
def _(spark, sf):
    """Exact quantiles over all line items."""
    return rounded(quantiles(adapters.load(spark, sf, "lineitem"), "l_extendedprice", QUANTILES), "value", digits=6)


@query(
    "trailing_averages",
    sql(
        """SELECT asset, CAST(ts AS VARCHAR) AS ts, close, week_number, week_count, flag_50, flag_100,
        avg(close) OVER (PARTITION BY asset) AS avg_overall,
        avg(close) OVER (PARTITION BY asset, flag_50) AS avg_50,
        avg(close) OVER (PARTITION BY asset, flag_100) AS avg_100
        FROM (SELECT *, CAST(week_number < 51 AS INT) AS flag_50, CAST(week_number < 100 AS INT) AS flag_100 FROM numbered)""",
        "numbered",
    ),
)
def _(spark, sf):
    return as_text(prices.trailing_averages(_closes(adapters.recent_bars(spark, sf))), "ts")


@query(
    "latest_averages",
    sql(
        """SELECT asset, week_count, tier, CAST(first_ts AS VARCHAR) AS first_ts, avg_overall,
        avg_50, avg_100 FROM averages""",
        "averages",
    ),
)
def _(spark, sf):
    averages = prices.latest_averages(adapters.recent_bars(spark, sf))
    return as_text(averages, "first_ts")


_TIERS_SQL = """SELECT asset, count(*) AS week_count, CASE WHEN count(*) >= 200 THEN '200' WHEN count(*) >= 100 THEN '100'
  WHEN count(*) >= 75 THEN '50' ELSE 'overall' END AS tier FROM all_bars GROUP BY asset"""


@query("history_tier", sql("SELECT tier, count(*) AS assets, min(week_count) AS fewest, max(week_count) AS most FROM tiers GROUP BY tier", "all_bars", tiers=_TIERS_SQL))
def _(spark, sf):
    lengths = adapters.weekly_bars(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("weeks"))
    return lengths.groupBy(prices.history_tier(F.col("weeks")).alias("tier")).agg(
        F.count(F.lit(1)).alias("assets"), F.min("weeks").alias("fewest"), F.max("weeks").alias("most")
    )


@query(
    "average_table",
    sql(
        """SELECT a.asset AS asset_tick, p.base AS asset, l.price AS current_price, a.week_count,
        a.week_count || ' Week Average' AS overall_title, a.avg_overall,
        CASE WHEN a.tier <> 'overall' THEN a.avg_50 END AS avg_50,
        CASE WHEN a.tier IN ('100', '200') THEN a.avg_100 END AS avg_100
        FROM averages a
        LEFT JOIN (SELECT DISTINCT asset_tick, CASE base WHEN 'XXBT' THEN 'BTC' WHEN 'XETH' THEN 'ETH' ELSE base END AS base
          FROM pairs) p ON p.asset_tick = a.asset
        LEFT JOIN (SELECT ticker, round(price, 4) AS price FROM quotes) l ON l.ticker = p.base
        WHERE a.tier IS NOT NULL""",
        "averages", "pairs", "quotes",
    ),
)
def _(spark, sf):
    bars, as_of = adapters.weekly_bars(spark, sf), adapters.last_week(spark, sf)
    pairs = adapters.shape(spark, sf, "pairs").filter(F.col("altname").contains("USD"))
    return run_averages(bars, pairs, adapters.listings(spark, sf), as_of)["average_table"]


@query(
    "printed_averages",
    sql(
        """SELECT CASE p.base WHEN 'XETH' THEN 'ETH' ELSE p.base END AS "Asset", l.price AS "Current Price",
        a.avg_50 AS "50 Week Average", a.avg_100 AS "100 Week Average", a.avg_overall AS "200 Week Average"
        FROM averages a JOIN pairs p ON p.asset_tick = a.asset
        LEFT JOIN (SELECT ticker, round(price, 4) AS price FROM quotes) l ON l.ticker = 'ETH'
        WHERE a.asset = 'XETHZUSD' AND contains(p.altname, 'USD')""",
        "averages", "pairs", "quotes",
    ),
)
def _(spark, sf):
    """One asset's table as printed; its tier and weeks name the columns, so its row is looked up first."""
    bars, as_of = adapters.weekly_bars(spark, sf), adapters.last_week(spark, sf)
    pairs = adapters.shape(spark, sf, "pairs").filter(F.col("altname").contains("USD"))
    table = run_averages(bars.filter("asset = 'XETHZUSD'"), pairs, adapters.listings(spark, sf), as_of)["average_table"]
    return printed_average_table(table, "XETHZUSD")


@query(
    "in_zone",
    "SELECT event_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS VARCHAR) AS shown FROM events",
)
def _(spark, sf):
    events = adapters.load(spark, sf, "events")
    return events.select("event_id", in_zone(F.col("ts"), "America/New_York").cast("string").alias("shown"))


@query(
    "average_chart_series",
    sql(
        """SELECT asset, CAST(ts AS VARCHAR) AS ts, close, avg_overall, CASE WHEN week_count >= 100 THEN avg_100 END AS avg_100,
        CASE WHEN week_count >= 75 THEN avg_50 END AS avg_50
        FROM (SELECT *, avg(close) OVER whole AS avg_overall, avg(close) FILTER (WHERE week_number <= 99) OVER whole AS avg_100,
            avg(close) FILTER (WHERE week_number <= 50) OVER whole AS avg_50
          FROM numbered WINDOW whole AS (PARTITION BY asset)) n""",
        "numbered",
    ),
)
def _(spark, sf):
    bars = _closes(adapters.recent_bars(spark, sf))
    series = prices.average_chart_series(bars, prices.latest_averages(bars))
    return as_text(series, "ts")


@query(
    "average_chart_labels",
    sql(
        f"""SELECT asset, first_ts, series, level, {dollar_sql('level', 2)} AS label FROM (
        SELECT asset, CAST(first_ts AS VARCHAR) AS first_ts, week_count || ' Week Average' AS series, avg_overall AS level
          FROM averages WHERE tier IS NOT NULL
        UNION ALL SELECT asset, CAST(first_ts AS VARCHAR), '100 Week Average', avg_100 FROM averages WHERE tier IN ('200', '100')
        UNION ALL SELECT asset, CAST(first_ts AS VARCHAR), '50 Week Average', avg_50 FROM averages
          WHERE tier IN ('200', '100', '50'))""",
        "averages",
    ),
)
def _(spark, sf):
    labels = prices.average_chart_labels(prices.latest_averages(adapters.recent_bars(spark, sf)))
    return as_text(labels, "first_ts")
