"""Incident table: building, filtering, county totals and the map table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywick.domains import AGE_RANGES, ALL, NOT_REPORTED, OUTCOME_LABEL, SOLVED
from tallywick.functions.ages import age_in, age_range
from tallywick.functions.counting import WEIGHT, cells
from tallywick.functions.text import without_blanks

LABEL_COLUMNS = ("Weapon", "VicSex", "VicRace", "OffSex", "OffRace")


def build_incidents(cases: DataFrame, codes: DataFrame) -> DataFrame:
    """Cases with the county code of the same ``ID``, blanks removed from the code.

    A left join: a case without a code stays, a case with several codes is repeated once per code row. Both sides
    move once; an ``ID`` with very many cases is left to the adaptive skew join, which may split the left side.

    There are about as many codes as cases, so they are merged whatever size they seem to have: that of rows which
    Python reads from files is a guess, and may have them broadcast. Cases without an ``ID`` meet no code; they are
    dealt by what else they hold instead of going to one task.
    """
    has_id = F.when(F.col("ID").isNotNull(), F.lit(0).cast("bigint"))
    named = codes.select("ID", without_blanks(F.col("CNTYFIPS")).alias("county_fips"), has_id.alias("_deal"))
    dealt = cases.withColumn("_deal", has_id.otherwise(F.xxhash64(*cases.columns)))
    return dealt.join(named.hint("merge"), ["ID", "_deal"], "left").select(*cases.columns, "county_fips")


def with_age_ranges(incidents: DataFrame) -> DataFrame:
    return incidents.withColumns(
        {"VicAgeRange": age_range(F.col("VicAge")), "OffAgeRange": age_range(F.col("OffAge"))}
    )


def filter_domains(incidents: DataFrame, states: DataFrame) -> DataFrame:
    """Values to choose from, as rows ``(domain, value, first_year, last_year)``.

    One scan: the label combinations are counted down to a few thousand rows before anything is spread
    out per column. The ``Year`` row carries the year limits; state names come from the lookup and the age
    ranges are fixed.
    """
    combos = incidents.groupBy(*LABEL_COLUMNS).agg(F.min("Year").alias("lo"), F.max("Year").alias("hi"))
    none = F.lit(None)
    entries = [
        F.struct(F.lit(name).alias("domain"), F.col(name).alias("value"), none.cast("int").alias("lo"),
                 none.cast("int").alias("hi"))
        for name in LABEL_COLUMNS
    ]
    entries.append(F.struct(F.lit("Year").alias("domain"), none.cast("string").alias("value"),
                            F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")))
    spread = combos.select(F.inline(F.array(*entries)))
    from_data = spread.groupBy("domain", "value").agg(
        F.min("lo").alias("first_year"), F.max("hi").alias("last_year")
    )
    names = states.select(F.lit("State").alias("domain"), F.col("State_Name").alias("value")).distinct()
    ages = incidents.sparkSession.range(1).select(
        F.lit("AgeRange").alias("domain"), F.explode(F.array(*map(F.lit, AGE_RANGES))).alias("value")
    )
    return from_data.unionByName(names.unionByName(ages), allowMissingColumns=True)


def incident_predicate(
    years: tuple[int, int],
    solved: int = ALL,
    weapon: Iterable[str] | None = None,
    state: Iterable[str] | None = None,
    victim: Mapping[str, Iterable[str]] | None = None,
    offender: Mapping[str, Iterable[str]] | None = None,
) -> Column:
    """The map's filter as one condition. ``None`` switches a filter off, an empty list lets nothing through.

    ``victim`` and ``offender`` map ``sex``, ``race`` and ``age`` to the chosen values. The offender filter
    applies to solved cases only; with any other outcome it is ignored.
    """
    tests = [F.col("Year").between(*years)]
    if solved != ALL:
        tests.append(F.col("Solved") == OUTCOME_LABEL[solved])
    if weapon is not None:
        tests.append(F.col("Weapon").isin(*weapon))
    if state is not None:
        tests.append(F.col("State").isin(*state))
    if victim is not None:
        tests += _person("Vic", victim)
    if offender is not None and solved == SOLVED:
        tests += _person("Off", offender)
    return reduce(lambda a, b: a & b, tests)


def _person(prefix: str, chosen: Mapping[str, Iterable[str]]) -> list[Column]:
    return [
        F.col(f"{prefix}Sex").isin(*chosen["sex"]),
        F.col(f"{prefix}Race").isin(*chosen["race"]),
        age_in(F.col(f"{prefix}Age"), chosen["age"]),
    ]


def filter_incidents(incidents: DataFrame, years: tuple[int, int], **chosen) -> DataFrame:
    """Rows passing :func:`incident_predicate`."""
    return incidents.filter(incident_predicate(years, **chosen))


def count_by_label(incidents: DataFrame, *within: str) -> DataFrame:
    """Cases per county label, on every ``(label, code)`` pair that occurs.

    The total belongs to the label: a label with two codes shows its whole total on both. All rows are read
    once and counted down to pairs; the window then adds up the few pairs of a label. (Joining totals back
    to the pairs would read the incidents twice, because the two sides need different columns.)
    """
    label = [*within, "CNTYFIPS"]
    pairs = cells(incidents, *label, "county_fips")
    total = F.sum(WEIGHT).over(Window.partitionBy(*label))
    return pairs.select(*label, "county_fips", total.alias("total"))


def county_totals(incidents: DataFrame) -> DataFrame:
    """``(CNTYFIPS, county_fips, county_total)``; see :func:`count_by_label`."""
    return count_by_label(incidents).withColumnRenamed("total", "county_total")


def county_map(counties: DataFrame, totals: DataFrame, states: DataFrame) -> DataFrame:
    """County boundaries that have cases, with label, state name and total.

    Boundaries without cases are left out, and so are totals whose code has no boundary. The join hints are
    left to the size checks of the planner: totals and lookups are small once counted.
    """
    placed = counties.join(totals, F.col("GEOID") == F.col("county_fips"))
    named = placed.join(states, F.col("STATEFP") == F.col("st_fips"), "left")
    return named.select("State_Name", "CNTYFIPS", "GEOID", "county_total", "geometry").distinct()


def map_labels(county_map: DataFrame) -> DataFrame:
    """Adds the label text ``<county>, <total>``; a missing county name reads ``NA``."""
    text = F.concat_ws(", ", F.coalesce("CNTYFIPS", F.lit("NA")), F.col("county_total").cast("string"))
    return county_map.withColumn("label", text)


def report_states(incidents: DataFrame) -> DataFrame:
    """States that can get a report."""
    return incidents.filter(~F.col("State").isin(*NOT_REPORTED)).select("State").distinct()


def state_year_range(incidents: DataFrame) -> DataFrame:
    """First and last year per state."""
    return incidents.groupBy("State").agg(
        F.min("Year").alias("min_year"), F.max("Year").alias("max_year")
    )
