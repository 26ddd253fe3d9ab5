"""The state report run: all tables of all reports from one pass over the incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tallywick.domains import NOT_REPORTED
from tallywick.operators import report as r
from tallywick.session import materialize_all
from tallywick.sources.tables import publish_report


def facts(people: DataFrame, overview: DataFrame, counts: DataFrame, years: r.Years = None) -> DataFrame:
    """:func:`report_facts` with the year limits of the report."""
    return r.with_year_limits(people, r.report_facts(overview, counts), years)


def report_tables(
    people: DataFrame,
    places: DataFrame,
    counties: DataFrame,
    states: DataFrame,
    years: r.Years = None,
    seen: tuple[int | None, int | None] | None = None,
) -> dict[str, DataFrame]:
    """Every table of the report by name, from the two cell tables; ``seen`` are the first and last year of ``places``.

    The few summaries that several tables start from, a row per state or county, are written out first.
    """
    max_year = None if years is None else years[1]
    shared = materialize_all(
        {
            "overview": r.case_overview(people, years),
            "counts": r.unsolved_counts(people, years),
            "recent_counts": r.recent_unsolved_counts(people, max_year),
            "by_county": r.county_unsolved(places, years),
        }
    )
    overview, counts, by_county = shared["overview"], shared["counts"], shared["by_county"]
    race_sex = r.unsolved_race_sex(counts)
    recent = r.recent_race_sex(shared["recent_counts"])
    county_map = r.county_unsolved_map(places, counties, states, years)
    return {
        "facts": facts(people, overview, counts, years),
        "case_overview": overview,
        "case_outcome": r.outcome_long(overview),
        "victim_sex": r.victim_sex_long(r.victim_sex_counts(people, years)),
        "offender_sex": r.offender_sex_long(r.offender_sex_counts(people, years)),
        "unsolved_counts": counts,
        "race_sex": race_sex,
        "race_sex_table": r.unsolved_race_sex_wide(race_sex),
        "solve_rate_by_race": r.solve_rate_by_race(people, years),
        "weapons": r.unsolved_weapons(counts),
        "county_map": county_map.withColumnRenamed("State_Name", "State"),
        "top_counties": r.top_counties(by_county),
        "all_counties": r.all_counties_table(by_county),
        "recent_counts": shared["recent_counts"],
        "recent_race_sex": recent,
        "recent_race_sex_table": r.unsolved_race_sex_wide(recent),
        "county_by_year": r.county_by_year(places, max_year, seen=seen),
    }


def run_report(
    incidents: DataFrame,
    counties: DataFrame,
    states: DataFrame,
    path: str,
    years: r.Years = None,
    only_states: list[str] | None = None,
    format: str = "parquet",
    titles: bool = False,
) -> dict[str, DataFrame]:
    """Publishes every report table below ``path``, one folder per table and state, rows in printed order.

    A run replaces what an earlier one published there, or with ``only_states`` these states' rows only, also of
    tables in which a state now has no rows. A run that stops half-way replaces nothing; see ``publish_report`` and
    ``read_report_table``.

    The incidents of the years in question are read twice, each time with the columns of one cell table
    only. The cells are written to the shared folder, so all tables start from small files, also after the
    loss of an executor.
    """
    if only_states is None:
        wanted = incidents.filter(~F.col("State").isin(*NOT_REPORTED))
        states = states.filter(~F.col("State_Name").isin(*NOT_REPORTED))
    else:
        wanted = incidents.filter(F.col("State").isin(*only_states))
        states = states.filter(F.col("State_Name").isin(*only_states))
    if years is not None:
        # nothing in a report is older than its range or its recent years
        wanted = wanted.filter(F.col("Year") >= min(years[0], years[1] - r.RECENT_YEARS))
    # the years are seen while the cells are written
    watch = Observation()
    places = r.place_cells(wanted).observe(watch, F.min("Year").alias("first"), F.max("Year").alias("last"))
    cells = materialize_all({"people": r.people_cells(wanted, years), "places": places})
    seen = watch.get["first"], watch.get["last"]
    tables = report_tables(cells["people"], cells["places"], counties, states, years, seen)
    publish_report(tables, path, format, titles, only_states)
    return tables
