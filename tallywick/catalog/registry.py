"""Registration of queries and the SQL blocks their checks are built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywick import adapters

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

YEARS = (1996, 2000)
MAX_YEAR = 2000

# --- SQL building blocks --------------------------------------------------------------------------------

_BARE = {t: t for t in ("orders", "customer", "nation", "region", "supplier")}
_CTE = {name: text.format(**_BARE) for name, text in adapters.SQL.items()}
_CTE["people"] = f"SELECT * FROM incidents WHERE Year BETWEEN {YEARS[0]} AND {YEARS[1]}"
_CTE["open_cases"] = "SELECT * FROM people WHERE Solved = 'No'"
_CTE["recent_open"] = f"SELECT * FROM incidents WHERE Solved = 'No' AND Year >= {MAX_YEAR} - 3"
_CTE["all_bars"] = """
SELECT asset, week AS ts, arg_min(lo, day) AS open, max(hi) AS high, min(lo) AS low, arg_max(hi, day) AS close,
  sum(quantity) AS volume, CAST(sum(n) AS BIGINT) AS trades
FROM (SELECT asset, day, CAST(date_trunc('week', day) AS DATE) AS week, min(price) AS lo, max(price) AS hi,
    sum(quantity) AS quantity, count(*) AS n
  FROM (SELECT unnest([CASE l_returnflag WHEN 'A' THEN 'XXBTZUSD' WHEN 'N' THEN 'XETHZUSD' WHEN 'R' THEN 'XLTCZUSD' END,
        'T' || l_suppkey || 'USD', 'T' || l_suppkey || l_returnflag || 'USD']) AS asset,
      CAST(l_shipdate AS DATE) AS day, floor(l_extendedprice) AS price, l_quantity AS quantity FROM lineitem) t
  GROUP BY asset, day) d
GROUP BY asset, week"""
_CTE["bars"] = "SELECT * FROM all_bars WHERE ts > (SELECT max(ts) FROM all_bars) - 1400"
_CTE["numbered"] = """
SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS week_number,
  count(*) OVER (PARTITION BY asset) AS week_count FROM bars"""
_CTE["averages"] = """
SELECT asset, count(*) AS week_count, avg(close) AS avg_overall, min(ts) AS first_ts,
  avg(close) FILTER (WHERE week_number <= 50) AS avg_50, avg(close) FILTER (WHERE week_number <= 99) AS avg_100,
  CASE WHEN count(*) >= 200 THEN '200' WHEN count(*) >= 100 THEN '100' WHEN count(*) >= 75 THEN '50'
    ELSE 'overall' END AS tier
FROM numbered GROUP BY asset"""
_CTE["all_numbered"] = _CTE["numbered"].replace("FROM bars", "FROM all_bars")
_CTE["coins"] = """
SELECT id, coin, ticker, slug, max_supply, circulating_supply, total_supply, round(price, 4) AS price, volume_24h,
  round(percent_change_1h / 100, 4) AS percent_change_1h, round(percent_change_24h / 100, 4) AS percent_change_24h,
  round(percent_change_7d / 100, 4) AS percent_change_7d, round(percent_change_30d / 100, 4) AS percent_change_30d,
  round(percent_change_60d / 100, 4) AS percent_change_60d, round(percent_change_90d / 100, 4) AS percent_change_90d,
  round(market_cap_dominance / 100, 4) AS market_cap_dominance, market_cap,
  '2013-04-28' AS date_added, '2022-09-02 12:34:56' AS last_updated
FROM quotes"""
_NEEDS = {
    "people": ("incidents",),
    "open_cases": ("people",),
    "recent_open": ("incidents",),
    "bars": ("all_bars",),
    "numbered": ("bars",),
    "all_numbered": ("all_bars",),
    "averages": ("numbered",),
    "coins": ("quotes",),
}


def sql(body: str, *needs: str, **ctes: str) -> str:
    """``body`` below the named building blocks and any of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} AS ({_CTE[name]})" for name in order] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def dollar_sql(amount: str, digits: int) -> str:
    # through a decimal, so that a tie is a tie whatever its binary form
    text = f"CAST(CAST(round(CAST({amount} AS DECIMAL(30, 10)), {digits}) AS DECIMAL(30, {digits})) AS VARCHAR)"
    return f"'$' || rtrim(rtrim({text}, '0'), '.')"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.shape(spark, sf, "incidents")


def lookups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return adapters.shape(spark, sf, "counties"), adapters.shape(spark, sf, "states")


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
