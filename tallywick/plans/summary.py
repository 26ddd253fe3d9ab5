"""Requests answered from a stored summary: how many cases there are per combination of what a request can ask.

The summary of a year is a table of counts over every column that the map's filter and totals use, ages as the first age
of their range. It is much smaller than the cases, adds up with other summaries, and is an incident table itself: the
filter, the totals and the map read it unchanged, each row standing for as many cases as it counts. Years are published
one by one: a new summary is made of the year folders that changed since, or the counts of new cases are added.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywick import schemas
from tallywick.functions.ages import age_floor
from tallywick.functions.counting import WEIGHT, cells
from tallywick.plans.county_map import MapRequest, is_complete, run_map
from tallywick.sources.published import Published
from tallywick.sources.tables import read_incidents

#: What a request can ask about, and what its answer shows.
COLUMNS = (
    "Year", "State", "CNTYFIPS", "county_fips", "Solved", "Weapon", "VicSex", "VicRace", "VicAge", "OffSex", "OffRace", "OffAge",
)
_KINDS = dict(field.split() for field in schemas.INCIDENTS.split(", "))
SCHEMA = ", ".join(f"{name} {_KINDS[name]}" for name in COLUMNS) + f", {WEIGHT} bigint"
#: Part that holds cases without a year; no request asks for them.
_NO_YEAR = "none"
_NO_YEAR_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def count_cases(incidents: DataFrame) -> DataFrame:
    """Cases per combination of ``COLUMNS``. Counts form in the tasks first, so a common combination is a row per task.

    Summaries may be counted again: of two unions, of years, or of fewer columns.
    """
    floors = {name: age_floor(F.col(name)) for name in ("VicAge", "OffAge")}
    return cells(incidents.withColumns(floors), *COLUMNS)


def _part(year: int | None) -> str:
    return _NO_YEAR if year is None else str(year)


def _publish(counted: DataFrame, store: Published) -> tuple[str, set[str]]:
    """Writes a run of counted cases by year; returns the run and the parts it holds."""
    run = store.new_run()
    folder = store.run_folder(run)
    counted.hint("rebalance", "Year").sortWithinPartitions("Year", "State").write.partitionBy("Year").parquet(folder)
    years = counted.sparkSession.read.schema(SCHEMA).parquet(folder).select("Year").distinct()
    # a row per year of the data
    return run, {_part(row["Year"]) for row in years.collect()}


def _snapshot_marks(spark: SparkSession, incidents_path: str) -> dict[str, str]:
    """For each year folder of a snapshot a mark that changes with its files: their names, sizes and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(incidents_path)
    year = F.regexp_extract("path", r"/Year=([^/]+)/[^/]+$", 1)
    mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).cast("string")
    rows = files.where(F.col("path").endswith(".parquet")).groupBy(year.alias("year")).agg(mark.alias("mark")).collect()
    return {_part(int(r["year"]) if r["year"].lstrip("-").isdigit() else None): r["mark"] for r in rows}


def update_summary(spark: SparkSession, incidents_path: str, summary_path: str) -> list[str]:
    """Brings the summary of a snapshot up to date: counts the year folders that are new or have changed, drops those gone.

    Returns the years counted. Nothing but the listing is read of other years; readers see the new summary as a whole.
    """
    store, marks = Published(summary_path), _snapshot_marks(spark, incidents_path)
    held = store.parts()
    stale = sorted(part for part, mark in marks.items() if held.get(part, {}).get("note") != mark)
    changes: dict[str, dict | None] = {part: None for part in held if part not in marks}
    if stale:
        years = [int(part) for part in stale if part != _NO_YEAR]
        wanted = F.col("Year").isin(*years)
        if _NO_YEAR in stale:
            wanted = wanted | F.col("Year").isNull()
        run, found = _publish(count_cases(read_incidents(spark, incidents_path).where(wanted)), store)
        changes |= {part: {"runs": [run] if part in found else [], "note": marks[part]} for part in stale}
    if changes:
        store.commit(changes)
    return stale


def add_cases(incidents: DataFrame, summary_path: str) -> None:
    """Adds the counts of new cases to the summary, beside those of their years; the cases counted before are not read."""
    store = Published(summary_path)
    run, found = _publish(count_cases(incidents), store)
    store.add({part: {"runs": [run], "note": None} for part in found})


def read_summary(spark: SparkSession, summary_path: str, years: Iterable[int] | None = None) -> DataFrame:
    """The counts of all years, or of some: only their folders are read."""
    store = Published(summary_path)
    wanted = None if years is None else {str(y) for y in years}
    folders: dict[str, list[str]] = {}
    for part, entry in store.parts().items():
        if wanted is None or part in wanted:
            for run in entry["runs"]:
                folders.setdefault(run, []).append(part)
    found = spark.createDataFrame([], SCHEMA)
    for run, parts in folders.items():
        base = store.run_folder(run)
        years = [f"{base}/Year={_NO_YEAR_FOLDER if p == _NO_YEAR else p}" for p in parts]
        found = found.unionByName(spark.read.schema(SCHEMA).option("basePath", base).parquet(*years))
    return found


def covered_years(summary_path: str) -> tuple[int, int] | None:
    """First and last year of the summary, from its pointer alone; nothing, if it has no year."""
    years = [int(part) for part, entry in Published(summary_path).parts().items() if part != _NO_YEAR and entry["runs"]]
    return (min(years), max(years)) if years else None


def answer(
    spark: SparkSession, summary_path: str, counties: DataFrame, states: DataFrame, request: MapRequest
) -> DataFrame:
    """The map of a request (see :func:`run_map`) from the summary, without reading a case.

    Every filter of a request is on columns of the summary, and the years it has are those of the data, so it covers
    all requests. One that is not complete, or reaches beyond the data, has an empty map, found without a job.
    """
    limits = covered_years(summary_path) or (1, 0)
    first, last = request.years
    inside = is_complete(request) and limits[0] <= first and last <= limits[1]
    years = range(first, last + 1) if inside else ()
    return run_map(read_summary(spark, summary_path, years), counties, states, request, limits)

