"""Queries over documents, the market, and tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick import adapters, schemas
from tallywick.catalog.incidents import BUILT_SQL
from tallywick.catalog.registry import YEARS, as_text, dollar_sql, query, sql
from tallywick.domains import RACES, SEXES, UNSOLVED, WEAPONS
from tallywick.operators import incidents as inc, market
from tallywick.plans.intake import COINS, take_in, taken_rows
from tallywick.plans.market import run_market
from tallywick.session import scratch_path
from tallywick.sources import boundaries, documents, survey, tables


@query("pair_catalog", sql("SELECT * FROM pairs WHERE contains(altname, 'USD')", "pairs"))
def _(spark, sf):
    return documents.pair_catalog(adapters.pair_documents(spark, sf))


@query(
    "pair_choices",
    sql(
        """SELECT asset_tick, regexp_replace(asset_tick, 'USD', ' USD') AS display_name,
        replace(regexp_replace(asset_tick, 'USD', ' USD'), ' USD', 'USD') AS chosen_key
        FROM pairs WHERE contains(altname, 'USD') AND NOT contains(asset_tick, 'USDT')""",
        "pairs",
    ),
)
def _(spark, sf):
    return market.pair_choices(documents.pair_catalog(adapters.pair_documents(spark, sf)))


@query(
    "ohlc_bars",
    sql(
        """SELECT asset, CAST(ts AS VARCHAR) || ' 00:00:00' AS ts, CAST(ts - 1 AS VARCHAR) || ' 19:00:00' AS date_est,
        open, high, low, close, close AS vwap, volume, trades FROM all_bars""",
        "all_bars",
    ),
)
def _(spark, sf):
    return as_text(documents.ohlc_bars(adapters.ohlc_documents(spark, sf)), "ts", "date_est")


@query("listings", sql("SELECT * FROM coins", "coins"))
def _(spark, sf):
    return as_text(documents.listings(adapters.listing_documents(spark, sf)), "date_added", "last_updated")


# fewer than there are at the smallest scale, so that the limit cuts
SHOWN = 40
_MARKET_SQL = f"""SELECT coin, ticker, price, round(volume_24h, 2) AS volume_24h, percent_change_24h AS volume_change_24h,
  percent_change_1h AS pct_change_1h, percent_change_24h AS pct_change_24h, percent_change_7d AS pct_change_7d,
  percent_change_30d AS pct_change_30d, round(market_cap, 2) AS market_cap, market_cap_dominance
FROM (SELECT * FROM coins ORDER BY market_cap DESC, id LIMIT {SHOWN})"""


@query("market_table", sql(_MARKET_SQL, "coins"))
def _(spark, sf):
    return market.market_table(documents.listings(adapters.listing_documents(spark, sf)), SHOWN)


@query("price_display", sql(f"SELECT *, {dollar_sql('price', 4)} AS price_text FROM ({_MARKET_SQL})", "coins"))
def _(spark, sf):
    return market.price_display(market.market_table(documents.listings(adapters.listing_documents(spark, sf)), SHOWN))


# --- sources and sinks ----------------------------------------------------------------------------------------


@query("cases_csv", sql("SELECT * EXCLUDE (county_fips) FROM incidents", "incidents"))
def _(spark, sf):
    path = scratch_path(spark, "cases")
    adapters.cases(spark, sf).write.csv(path, header=True, escape='"', nullValue="NA")
    return tables.read_cases(spark, path)


@query(
    "cases_csv_broken_lines",
    sql(
        "SELECT * EXCLUDE (county_fips) REPLACE (replace(CNTYFIPS, ', ', ',' || chr(10)) AS CNTYFIPS) FROM incidents", "incidents"
    ),
)
def _(spark, sf):
    """Cases whose county names hold a line break, read in parallel within their files."""
    path = scratch_path(spark, "cases")
    broken = adapters.cases(spark, sf).withColumn("CNTYFIPS", F.replace("CNTYFIPS", F.lit(", "), F.lit(",\n")))
    broken.write.csv(path, header=True, escape='"', nullValue="NA")
    return tables.read_cases(spark, path, multi_line=True)


#: Value labels of the survey files; the generated cases have one weapon beyond the listed ones.
_LABELS = {
    "Solved": ["Yes", "No", "Unknown"], "VicSex": SEXES, "OffSex": SEXES, "VicRace": RACES, "OffRace": RACES,
    "Weapon": [*WEAPONS, "Unlisted"],
}


@query("survey_cases", sql("SELECT * EXCLUDE (county_fips) FROM incidents", "incidents"))
def _(spark, sf):
    """Cases written as survey files with value labels, and read back in ranges."""
    path = scratch_path(spark, "survey")
    survey.write_survey(adapters.cases(spark, sf), path, _LABELS)
    return tables.read_survey_cases(spark, path)


@query("survey_incidents", sql(BUILT_SQL, "incidents", "codes"))
def _(spark, sf):
    """Cases with the county codes of the survey files."""
    path = scratch_path(spark, "codes")
    survey.write_survey(adapters.shape(spark, sf, "codes"), path)
    return inc.build_incidents(adapters.cases(spark, sf), tables.read_survey_codes(spark, path))


@query(
    "boundary_files",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS GEOID, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS STATEFP,
      CAST(CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS INT) AS parts,
      CAST(5 + CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 0 END AS INT) AS vertices,
      CAST((3 + c_custkey % 5) * (3 + c_custkey % 5) - CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END
        + CASE WHEN c_custkey % 7 = 0 THEN 4 ELSE 0 END AS DOUBLE) AS area
    FROM customer""",
)
def _(spark, sf):
    """Polygons written as boundary files and read back in ranges, with what their rings measure."""
    path = scratch_path(spark, "boundaries")
    boundaries.write_boundaries(adapters.boundary_shapes(spark, sf), path)
    return boundaries.with_measures(boundaries.read_boundaries(spark, path)).drop("geometry")


@query("codes_csv", sql("SELECT * FROM codes", "codes"))
def _(spark, sf):
    path = scratch_path(spark, "codes")
    adapters.shape(spark, sf, "codes").write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return tables.read_codes(spark, path)


@query("states_tsv", sql("SELECT * FROM states", "states"))
def _(spark, sf):
    path = scratch_path(spark, "states")
    adapters.shape(spark, sf, "states").write.csv(path, header=True, sep="\t")
    return tables.read_states(spark, path)


@query("counties_parquet", sql("SELECT GEOID, STATEFP, geometry FROM counties", "counties"))
def _(spark, sf):
    path = scratch_path(spark, "counties")
    tables.save_snapshot(adapters.shape(spark, sf, "counties"), path)
    return tables.read_counties(spark, path)


@query(
    "incident_snapshot",
    sql(
        f"SELECT * FROM ({BUILT_SQL}) WHERE Solved = 'No' AND Year BETWEEN {YEARS[0]} AND {YEARS[1]}", "incidents", "codes"
    ),
)
def _(spark, sf):
    """Built, saved by year, read back with a year filter that skips folders."""
    path = scratch_path(spark, "incidents")
    tables.save_incidents(
        inc.build_incidents(adapters.cases(spark, sf), adapters.shape(spark, sf, "codes")), path
    )
    saved = tables.read_incidents(spark, path).select(*[c.split()[0] for c in schemas.INCIDENTS.split(", ")])
    return inc.filter_incidents(saved, YEARS, solved=UNSOLVED)


@query("market_files", sql(f"SELECT *, {dollar_sql('price', 4)} AS price_text FROM ({_MARKET_SQL})", "coins"))
def _(spark, sf):
    """Listing documents landed as files, one document each, to the market table."""
    path = scratch_path(spark, "listings")
    adapters.listing_documents(spark, sf).write.option("maxRecordsPerFile", 1).text(path)
    return run_market(spark, path, SHOWN)


@query("pair_files", sql("SELECT * FROM pairs WHERE contains(altname, 'USD')", "pairs"))
def _(spark, sf):
    """Pair documents landed one per line."""
    path = scratch_path(spark, "pairs")
    adapters.pair_documents(spark, sf).write.text(path)
    return documents.pair_catalog(documents.read_documents(spark, path, one_per_line=True))


@query(
    "ohlc_files",
    sql(
        """SELECT asset, CAST(ts AS VARCHAR) || ' 00:00:00' AS ts, open, high, low, close FROM all_bars""",
        "all_bars",
    ),
)
def _(spark, sf):
    """Price documents landed one per line."""
    path = scratch_path(spark, "ohlc")
    adapters.ohlc_documents(spark, sf).write.text(path)
    bars = documents.ohlc_bars(documents.read_documents(spark, path, one_per_line=True))
    return as_text(bars.select("asset", "ts", "open", "high", "low", "close"), "ts")


@query(
    "bars_taken_in",
    sql(
        """SELECT asset, CAST(ts AS VARCHAR) || ' 00:00:00' AS ts, open, high, low, close, volume, trades FROM all_bars""",
        "all_bars",
    ),
)
def _(spark, sf):
    """Price documents that land in two steps; the second brings later years, and better prices of one year."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "bars")
    docs = adapters.dated_ohlc_documents(spark, sf)
    early = docs.where(F.col("year") <= YEARS[0])
    rough = F.when(F.col("year") == YEARS[0], F.replace("value", F.lit('.0"'), F.lit('.5"'))).otherwise(F.col("value"))
    early.select(rough.alias("value")).write.text(f"{landing}/1")
    take_in(spark, landing, path, one_per_line=True)
    docs.where(F.col("year") >= YEARS[0]).select("value").write.text(f"{landing}/2")
    take_in(spark, landing, path, one_per_line=True)
    bars = taken_rows(spark, path).select("asset", "ts", "open", "high", "low", "close", "volume", "trades")
    return as_text(bars, "ts")


@query("coins_taken_in", sql("SELECT * FROM coins", "coins"))
def _(spark, sf):
    """Listing pages that land in two steps, a file each."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "coins")
    pages = adapters.listing_documents(spark, sf).withColumn("odd", F.xxhash64("value") % 2 == 0)
    for step in (True, False):
        pages.where(F.col("odd") == step).select("value").write.option("maxRecordsPerFile", 1).text(f"{landing}/{step}")
        take_in(spark, landing, path, COINS)
    return as_text(taken_rows(spark, path, COINS), "date_added", "last_updated")
