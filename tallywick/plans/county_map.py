"""The county map run: request in, map table out."""

from __future__ import annotations

from collections.abc import Sequence, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallywick.domains import ALL
from tallywick.operators.breaks import color_position
from tallywick.operators.incidents import county_map, county_totals, filter_incidents, map_labels


@dataclass(frozen=True)
class MapRequest:
    """What the user chose; ``None`` means the filter is off (see ``incident_predicate``)."""

    years: tuple[int, int]
    solved: int = ALL
    weapon: Sequence[str] | None = None
    state: Sequence[str] | None = None
    victim: Mapping[str, Sequence[str]] | None = None
    offender: Mapping[str, Sequence[str]] | None = None

    def filters(self) -> dict:
        names = ("solved", "weapon", "state", "victim", "offender")
        return {name: getattr(self, name) for name in names}


def year_limits(incidents: DataFrame) -> tuple[int, int]:
    """First and last year of the data, found once before requests are answered."""
    found = incidents.agg(F.min("Year").alias("first"), F.max("Year").alias("last")).first()
    return found["first"], found["last"]


def is_complete(request: MapRequest) -> bool:
    """Years in order, and something chosen in a weapon or state filter that is on."""
    first, last = request.years
    return first <= last and all(choice is None or any(choice) for choice in (request.weapon, request.state))


def is_valid(request: MapRequest, limits: tuple[int, int]) -> bool:
    """A complete request whose years lie inside the data."""
    first, last = request.years
    return is_complete(request) and limits[0] <= first and last <= limits[1]


def map_table(incidents: DataFrame, counties: DataFrame, states: DataFrame, request: MapRequest) -> DataFrame:
    """Counties with their totals for the chosen cases, without the check of the request."""
    chosen = filter_incidents(incidents, request.years, **request.filters())
    return county_map(counties, county_totals(chosen), states)


def run_map(
    incidents: DataFrame,
    counties: DataFrame,
    states: DataFrame,
    request: MapRequest,
    limits: tuple[int, int] | None = None,
) -> DataFrame:
    """Map table with label and colour position; empty for an invalid request.

    ``limits`` are the data's first and last year (see :func:`year_limits`); an invalid request then reads nothing.
    Without them the limits are a subquery of the same job.
    """
    table = map_labels(color_position(map_table(incidents, counties, states, request), "county_total"))
    if limits is not None:
        return table if is_valid(request, limits) else table.limit(0)
    if not is_complete(request):
        return table.limit(0)
    first, last = request.years
    inside = (F.min("Year") <= first) & (F.max("Year") >= last)
    return table.filter(incidents.agg(inside.alias("inside")).scalar())
