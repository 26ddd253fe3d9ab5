"""Queries over incidents, the county map and its legend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywick import adapters
from tallywick.catalog.registry import ORACLES, YEARS, incidents, lookups, query, rounded, sql
from tallywick.domains import AGE_RANGES, ALL, SOLVED, UNSOLVED
from tallywick.operators import breaks, incidents as inc
from tallywick.plans.county_map import MapRequest, map_table, run_map
from tallywick.plans.summary import add_cases, answer, count_cases, read_summary, update_summary
from tallywick.session import scratch_path
from tallywick.sources import tables

HANDGUN, KNIFE, FIRE = "Handgun - pistol, revolver, etc", "Knife or cutting instrument", "Fire"
VICTIM = {"sex": ["Female", "Male"], "race": ["White", "Black", "Unknown"], "age": ["<1", "10-19", "70+", "Unknown"]}
OFFENDER = {"sex": ["Male", "Unknown"], "race": ["Asian", "White"], "age": ["1-9", "20-29", "30-39", "Unknown"]}
BY_AGE_IN_SQL = """CASE WHEN {age} = 0 THEN '<1' WHEN {age} BETWEEN 1 AND 9 THEN '1-9'
  WHEN {age} BETWEEN 10 AND 69 THEN (({age} // 10) * 10) || '-' || (({age} // 10) * 10 + 9)
  WHEN {age} BETWEEN 70 AND 554 THEN '70+' WHEN {age} = 999 THEN 'Unknown' END"""


BUILT_SQL = """SELECT i.* REPLACE (c.county_fips AS county_fips) FROM incidents i
  LEFT JOIN (SELECT ID, replace(CNTYFIPS, ' ', '') AS county_fips FROM codes) c ON c.ID = i.ID"""


@query("build_incidents", sql(BUILT_SQL, "incidents", "codes"))
def _(spark, sf):
    return inc.build_incidents(adapters.cases(spark, sf), adapters.shape(spark, sf, "codes"))


@query(
    "age_ranges",
    sql(
        f"""SELECT ID, VicAge, OffAge, {BY_AGE_IN_SQL.format(age='VicAge')} AS VicAgeRange,
        {BY_AGE_IN_SQL.format(age='OffAge')} AS OffAgeRange FROM incidents""",
        "incidents",
    ),
)
def _(spark, sf):
    return inc.with_age_ranges(incidents(spark, sf).select("ID", "VicAge", "OffAge"))


@query(
    "filter_domains",
    sql(
        " UNION ALL ".join(
            [
                f"""SELECT DISTINCT '{c}' AS domain, {c} AS value, CAST(NULL AS INT) AS first_year,
                CAST(NULL AS INT) AS last_year FROM incidents"""
                for c in inc.LABEL_COLUMNS
            ]
            + ["SELECT 'Year', NULL, min(Year), max(Year) FROM incidents"]
            + ["SELECT DISTINCT 'State', State_Name, CAST(NULL AS INT), CAST(NULL AS INT) FROM states"]
            + [f"SELECT 'AgeRange', '{a}', CAST(NULL AS INT), CAST(NULL AS INT)" for a in AGE_RANGES]
        ),
        "incidents",
        "states",
    ),
)
def _(spark, sf):
    return inc.filter_domains(incidents(spark, sf), adapters.shape(spark, sf, "states"))


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def person_sql(prefix: str, chosen: dict) -> str:
    return (
        f"{prefix}Sex IN {sql_list(chosen['sex'])} AND {prefix}Race IN {sql_list(chosen['race'])}"
        f" AND ({BY_AGE_IN_SQL.format(age=prefix + 'Age')}) IN {sql_list(chosen['age'])}"
    )


_FILTERS: dict[str, tuple[dict, str]] = {
    "filter_unsolved": ({"solved": UNSOLVED}, "Solved = 'No'"),
    "filter_all_outcomes": ({"solved": ALL}, "TRUE"),
    "filter_victim": ({"solved": ALL, "victim": VICTIM}, person_sql("Vic", VICTIM)),
    "filter_offender_solved": (
        {"solved": SOLVED, "offender": OFFENDER},
        "Solved = 'Yes' AND " + person_sql("Off", OFFENDER),
    ),
    "filter_offender_ignored": ({"solved": UNSOLVED, "offender": OFFENDER}, "Solved = 'No'"),
    "filter_weapon_state": (
        {"solved": ALL, "weapon": [HANDGUN, KNIFE], "state": ["ASIA", "EUROPE"]},
        f"Weapon IN ('{HANDGUN}', '{KNIFE}') AND State IN ('ASIA', 'EUROPE')",
    ),
    "filter_everything": (
        {"solved": SOLVED, "weapon": [HANDGUN, FIRE], "state": ["ASIA", "AFRICA"], "victim": VICTIM, "offender": OFFENDER},
        f"Solved = 'Yes' AND Weapon IN ('{HANDGUN}', '{FIRE}') AND State IN ('ASIA', 'AFRICA') AND "
        + person_sql("Vic", VICTIM) + " AND " + person_sql("Off", OFFENDER),
    ),
}


def _register_filter(name: str, chosen: dict, condition: str) -> None:
    @query(name, sql(f"SELECT * FROM people WHERE {condition}", "people"))
    def _(spark, sf):
        return inc.filter_incidents(incidents(spark, sf), YEARS, **chosen)


for _name, (_chosen, _condition) in _FILTERS.items():
    _register_filter(_name, _chosen, _condition)

_TOTALS_SQL = """SELECT DISTINCT CNTYFIPS, county_fips, county_total FROM
  (SELECT CNTYFIPS, county_fips, count(*) OVER (PARTITION BY CNTYFIPS) AS county_total FROM open_cases)"""


@query("county_totals", sql(_TOTALS_SQL, "open_cases"))
def _(spark, sf):
    return inc.county_totals(inc.filter_incidents(incidents(spark, sf), YEARS, solved=UNSOLVED))


_MAP_SQL = """SELECT DISTINCT State_Name, CNTYFIPS, GEOID, county_total, geometry
FROM counties LEFT JOIN totals ON GEOID = county_fips LEFT JOIN states ON STATEFP = st_fips
WHERE county_total IS NOT NULL"""


@query("county_map", sql(_MAP_SQL, "open_cases", "counties", "states", totals=_TOTALS_SQL))
def _(spark, sf):
    return map_table(incidents(spark, sf), *lookups(spark, sf), MapRequest(YEARS, UNSOLVED))


@query(
    "map_labels",
    sql(
        f"SELECT *, coalesce(CNTYFIPS, 'NA') || ', ' || county_total AS label FROM ({_MAP_SQL})",
        "open_cases", "counties", "states", totals=_TOTALS_SQL,
    ),
)
def _(spark, sf):
    return inc.map_labels(map_table(incidents(spark, sf), *lookups(spark, sf), MapRequest(YEARS, UNSOLVED)))


@query(
    "map_request",
    sql(
        f"""SELECT *, coalesce(CNTYFIPS, 'NA') || ', ' || county_total AS label,
        round((county_total - lo) / nullif(hi - lo, 0), 6) AS position
        FROM ({_MAP_SQL}), (SELECT min(county_total) AS lo, max(county_total) AS hi FROM ({_MAP_SQL}))""".replace(
            "SELECT *, coalesce", "SELECT State_Name, CNTYFIPS, GEOID, county_total, geometry, coalesce", 1
        ),
        "people", "counties", "states",
        open_cases=f"SELECT * FROM people WHERE Weapon IN ('{HANDGUN}', '{KNIFE}') AND {person_sql('Vic', VICTIM)}",
        totals=_TOTALS_SQL,
    ),
)
def _(spark, sf):
    request = MapRequest(YEARS, ALL, weapon=[HANDGUN, KNIFE], victim=VICTIM)
    table = run_map(incidents(spark, sf), *lookups(spark, sf), request)
    return rounded(table, "position", digits=6)


@query(
    "map_request_outside",
    sql(
        f"""SELECT *, coalesce(CNTYFIPS, 'NA') || ', ' || county_total AS label, CAST(0 AS DOUBLE) AS position FROM ({_MAP_SQL})
        WHERE (SELECT max(Year) FROM incidents) >= {YEARS[1] + 100}""",
        "open_cases", "counties", "states", totals=_TOTALS_SQL,
    ),
)
def _(spark, sf):
    """A request whose years reach beyond the data has an empty map."""
    return run_map(incidents(spark, sf), *lookups(spark, sf), MapRequest((YEARS[0], YEARS[1] + 100), UNSOLVED))


def _summary(spark: SparkSession, sf: str) -> str:
    """A snapshot's summary: two years are counted later than the others, and one of them is cut in two."""
    snapshot, path = scratch_path(spark, "snapshot"), scratch_path(spark, "summary")
    cases = incidents(spark, sf)
    tables.save_incidents(cases.where(F.col("Year") < YEARS[1]), snapshot)
    update_summary(spark, snapshot, path)
    late = cases.where(F.col("Year") >= YEARS[1])
    add_cases(late.where(F.col("Solved") == "Yes"), path)
    add_cases(late.where(F.col("Solved") != "Yes"), path)
    return path


@query(
    "summary_counts",
    sql(
        f"""SELECT Year, State, CNTYFIPS, county_fips, Solved, Weapon, VicSex, VicRace, {BY_AGE_IN_SQL.format(age='VicAge')} AS VicAgeRange,
        OffSex, OffRace, {BY_AGE_IN_SQL.format(age='OffAge')} AS OffAgeRange, count(*) AS n_cases FROM incidents GROUP BY ALL""",
        "incidents",
    ),
)
def _(spark, sf):
    """The counts of a summary that was brought up to date in steps, with the labels of its ages."""
    counts = inc.with_age_ranges(count_cases(read_summary(spark, _summary(spark, sf))))
    return counts.drop("VicAge", "OffAge")


_REQUEST = MapRequest(YEARS, ALL, weapon=[HANDGUN, KNIFE], victim=VICTIM)


@query("summary_request", ORACLES["map_request"])
def _(spark, sf):
    """The request of ``map_request``, answered from the summary."""
    found = answer(spark, _summary(spark, sf), *lookups(spark, sf), _REQUEST)
    return rounded(found, "position", digits=6)


@query("summary_request_outside", ORACLES["map_request_outside"])
def _(spark, sf):
    """Years beyond the data: an empty map, without a job."""
    return answer(spark, _summary(spark, sf), *lookups(spark, sf), MapRequest((YEARS[0], YEARS[1] + 100), UNSOLVED))


# --- legend breaks ----------------------------------------------------------------------------------------


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return inc.county_totals(incidents(spark, sf))


_ALL_TOTALS_SQL = _TOTALS_SQL.replace("open_cases", "incidents")


_CUTS_SQL = """SELECT lo, hi, cut FROM
  (SELECT lo, hi, unnest(range(CAST(floor(lo / step) AS BIGINT), CAST(ceil(hi / step) AS BIGINT) + 1)) * step AS cut
   FROM (SELECT lo, hi, CASE WHEN 2 * b - cell >= 1.5 * (cell - b) THEN b
       WHEN 5 * b - cell >= 2.75 * (cell - 2 * b) THEN 2 * b
       WHEN 10 * b - cell >= 1.5 * (cell - 5 * b) THEN 5 * b ELSE 10 * b END AS step
     FROM (SELECT lo, hi, cell, power(10.0, floor(log10(cell))) AS b
       FROM (SELECT CAST(min(county_total) AS DOUBLE) AS lo, CAST(max(county_total) AS DOUBLE) AS hi,
           CAST(max(county_total) - min(county_total) AS DOUBLE) / 7 AS cell FROM totals))))
  WHERE cut BETWEEN lo AND hi"""


@query(
    "legend_breaks_numeric",
    sql(
        "SELECT cut, round((cut - lo) / (hi - lo), 6) AS position FROM cuts",
        "incidents", totals=_ALL_TOTALS_SQL, cuts=_CUTS_SQL,
    ),
)
def _(spark, sf):
    return rounded(breaks.legend_breaks_numeric(_totals(spark, sf), "county_total"), "position", digits=6)


@query(
    "legend_breaks_bin",
    sql(
        """SELECT bin, midpoint FROM (SELECT row_number() OVER (ORDER BY cut) - 1 AS bin,
        (cut + lead(cut) OVER (ORDER BY cut)) / 2 AS midpoint FROM cuts) WHERE midpoint IS NOT NULL""",
        "incidents", totals=_ALL_TOTALS_SQL, cuts=_CUTS_SQL,
    ),
)
def _(spark, sf):
    # about seven round cuts serve as the bins' limits
    cuts = breaks.legend_breaks_numeric(_totals(spark, sf), "county_total")
    limits = cuts.agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    return breaks.legend_breaks_bin(limits, "cuts").withColumn("bin", F.col("bin").cast("bigint"))


_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query(
    "legend_breaks_quantile",
    sql(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, CAST({p} AS DOUBLE) AS prob, quantile_cont(CAST(county_total AS DOUBLE), {p}) AS value FROM totals"
            for kind, probs in (("cut", _PROBS), ("mid", (0.125, 0.375, 0.625, 0.875)))
            for p in probs
        ),
        "incidents", totals=_ALL_TOTALS_SQL,
    ),
)
def _(spark, sf):
    return breaks.legend_breaks_quantile(_totals(spark, sf), "county_total", _PROBS)


@query("legend_breaks_factor", sql("SELECT DISTINCT Weapon FROM incidents WHERE Weapon IS NOT NULL", "incidents"))
def _(spark, sf):
    return breaks.legend_breaks_factor(incidents(spark, sf), "Weapon")


@query(
    "color_position",
    sql(
        """SELECT CNTYFIPS, county_fips, county_total, round((county_total - min(county_total) OVER ())
        / (max(county_total) OVER () - min(county_total) OVER ()), 6) AS position FROM totals""",
        "incidents", totals=_ALL_TOTALS_SQL,
    ),
)
def _(spark, sf):
    return rounded(breaks.color_position(_totals(spark, sf), "county_total"), "position", digits=6)
