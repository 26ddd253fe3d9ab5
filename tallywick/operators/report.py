"""State report tables, all states in one pass.

Every function takes incident rows or pre-counted cells (see ``functions.counting``) and an optional year
range ``(first, last)``; ``None`` means all years, which is also each state's own first-to-last range.
All tables are keyed by ``State``. Windows run over the finished table of one state, which has no more
rows than there are labels or counties.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywick.domains import CHART_RACE, RACE_KEY, RACES, RECENT_CHART_RACE, SEXES, WEAPONS
from tallywick.functions.counting import WEIGHT, cells, percent, quoted, tally, weight
from tallywick.operators.incidents import count_by_label, state_year_range

Years = tuple[int, int] | None

PEOPLE_KEYS = ("State", "Year", "Solved", "VicSex", "VicRace", "OffSex", "Weapon")
PLACE_KEYS = ("State", "Year", "Solved", "CNTYFIPS", "county_fips")

RECENT_YEARS = 3  # before the report's last one

WEAPON_KEY = {
    label: "weapon_" + re.sub("[^a-z]+", "_", title.lower()).strip("_") for label, title in WEAPONS.items()
}
PERSON_KEY = {(sex, race): f"{sex.lower()}_{RACE_KEY[race]}" for race in RACES for sex in SEXES}


def in_years(df: DataFrame, years: Years) -> DataFrame:
    return df if years is None else df.filter(F.col("Year").between(*years))


def unsolved_rows(df: DataFrame, years: Years) -> DataFrame:
    return in_years(df, years).filter(F.col("Solved") == "No")


def recent_rows(df: DataFrame, max_year: int | None) -> DataFrame:
    """Rows from ``max_year - 3`` (``RECENT_YEARS``) on: four calendar years, and no upper limit.

    Without ``max_year`` each state's own last year counts; give cells then, since the year range is a
    second pass over ``df``.
    """
    if max_year is not None:
        return df.filter(F.col("Year") >= max_year - RECENT_YEARS)
    last = state_year_range(df).select(F.col("State").alias("_state"), "max_year")
    same = F.col("State").eqNullSafe(F.col("_state")) & (F.col("Year") >= F.col("max_year") - RECENT_YEARS)
    return df.join(last, same).select(*df.columns)


# --- whole caseload ---------------------------------------------------------------------------------


def case_overview(df: DataFrame, years: Years = None, strict_na: bool = False) -> DataFrame:
    """Unsolved, solved and all cases per state with the clearance rate.

    ``homi_count`` is solved plus unsolved; cases with any other outcome count in ``homicide_total`` only.
    """
    counts = in_years(df, years).groupBy("State").agg(
        tally("Solved = 'No'", df, strict_na).alias("unsolved"),
        tally("Solved = 'Yes'", df, strict_na).alias("solved"),
        F.sum(weight(df)).alias("homicide_total"),
    )
    both = F.col("solved") + F.col("unsolved")
    return counts.withColumns({"homi_count": both, "clear_rate": percent(F.col("solved"), both)})


def outcome_long(overview: DataFrame) -> DataFrame:
    """Overview as rows ``(case_outcome, total)``."""
    named = overview.select("State", F.col("unsolved").alias("Unsolved"), F.col("solved").alias("Solved"))
    long = named.unpivot("State", ["Unsolved", "Solved"], "case_outcome", "total")
    return long.withColumn("x", F.lit("Homicide Cases"))


def _sex_counts(df: DataFrame, column: str, years: Years, strict_na: bool) -> DataFrame:
    counts = [tally(f"{column} = '{sex}'", df, strict_na).alias(sex.lower()) for sex in SEXES]
    return in_years(df, years).groupBy("State").agg(*counts)


def _sex_long(counts: DataFrame, key: str, titles: dict[str, str]) -> DataFrame:
    named = counts.select("State", *[F.col(old).alias(new) for old, new in titles.items()])
    return named.unpivot("State", list(titles.values()), key, "total")


def victim_sex_counts(df: DataFrame, years: Years = None, strict_na: bool = False) -> DataFrame:
    """Cases per state by the victim's sex, one column each."""
    return _sex_counts(df, "VicSex", years, strict_na)


def victim_sex_long(counts: DataFrame) -> DataFrame:
    return _sex_long(counts, "victim_sex", {"male": "Male", "female": "Female", "unknown": "Unknown"})


def offender_sex_counts(df: DataFrame, years: Years = None, strict_na: bool = False) -> DataFrame:
    """Cases per state by the offender's sex, one column each."""
    return _sex_counts(df, "OffSex", years, strict_na)


def offender_sex_long(counts: DataFrame) -> DataFrame:
    return _sex_long(counts, "offender_sex", {"male": "Male", "female": "Female", "unknown": "Sex Unknown"})


def solve_rate_by_race(df: DataFrame, years: Years = None) -> DataFrame:
    """Unsolved and solved cases and the solve rate per state and victim race; absent outcomes are 0."""
    counts = in_years(df, years).groupBy("State", "VicRace").agg(
        tally("Solved = 'No'", df).alias("unsolved"), tally("Solved = 'Yes'", df).alias("solved")
    )
    rate = percent(F.col("solved"), F.col("solved") + F.col("unsolved"))
    return counts.withColumn("solve_rate", rate)


# --- unsolved cases by person and weapon ----------------------------------------------------------------


def _unsolved_tests() -> dict[str, str]:
    tests = {
        "female": "VicSex = 'Female'",
        "male": "VicSex = 'Male'",
        # counts the unknown *race*, as the published table does
        "unknown": "VicRace = 'Unknown'",
    }
    tests |= {RACE_KEY[race]: f"VicRace = {quoted(race)}" for race in RACES}
    tests |= {key: f"VicSex = '{sex}' AND VicRace = {quoted(race)}" for (sex, race), key in PERSON_KEY.items()}
    tests |= {key: f"Weapon = {quoted(label)}" for label, key in WEAPON_KEY.items()}
    return tests


def _count_unsolved(rows: DataFrame, strict_na: bool) -> DataFrame:
    # first down to label combinations, then the 44 conditions, so that they run on few rows
    combos = cells(rows, "State", "VicSex", "VicRace", "Weapon")
    counts = [tally(test, combos, strict_na).alias(name) for name, test in _unsolved_tests().items()]
    return combos.groupBy("State").agg(F.sum(WEIGHT).alias("unsolved"), *counts)


def unsolved_counts(df: DataFrame, years: Years = None, strict_na: bool = False) -> DataFrame:
    """One row per state: unsolved cases by sex, race, sex and race, and weapon (44 counts)."""
    return _count_unsolved(unsolved_rows(df, years), strict_na)


def recent_unsolved_counts(df: DataFrame, max_year: int | None = None, strict_na: bool = False) -> DataFrame:
    """:func:`unsolved_counts` over the recent years (see :func:`recent_rows`)."""
    return _count_unsolved(unsolved_rows(recent_rows(df, max_year), None), strict_na)


def unsolved_race_sex(counts: DataFrame, chart_names: dict[str, str] = CHART_RACE) -> DataFrame:
    """The 18 sex-by-race counts as rows, zero cells included; ``chart_race`` is the short race name."""
    rows = [
        f"{quoted(race)}, {quoted(chart_names.get(race, race))}, '{sex}', {key}"
        for (sex, race), key in PERSON_KEY.items()
    ]
    return counts.selectExpr("State", f"stack({len(rows)}, {', '.join(rows)}) AS (race, chart_race, sex, count)")


def recent_race_sex(recent_counts: DataFrame) -> DataFrame:
    """:func:`unsolved_race_sex` with the short names of the recent-years table."""
    return unsolved_race_sex(recent_counts, RECENT_CHART_RACE)


def unsolved_race_sex_wide(long: DataFrame) -> DataFrame:
    """One row per state and race: a column per sex, the row total and its share of all rows of the state."""
    sexes = [F.expr(f"sum(CASE WHEN sex = '{sex}' THEN count END)").alias(sex.lower()) for sex in SEXES]
    wide = long.groupBy("State", "race").agg(*sexes, F.sum("count").alias("total"))
    state_total = F.sum("total").over(Window.partitionBy("State"))
    return wide.withColumn("pct_of_unsolved", percent(F.col("total"), state_total))


def _leaders(df: DataFrame, column: str) -> DataFrame:
    place = F.rank().over(Window.partitionBy("State").orderBy(F.col(column).desc()))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def top_race(wide: DataFrame) -> DataFrame:
    """Race with the most unsolved cases per state, ties kept."""
    return _leaders(wide, "total").select("State", "race", "total")


def top_sex(long: DataFrame) -> DataFrame:
    """Sex with the most unsolved cases per state, ties kept."""
    return _leaders(long.groupBy("State", "sex").agg(F.sum("count").alias("total")), "total")


def unsolved_weapons(counts: DataFrame) -> DataFrame:
    """The 17 weapon counts as rows with their share of the unsolved cases."""
    values = ", ".join(f"{quoted(WEAPONS[label])}, {key}" for label, key in WEAPON_KEY.items())
    long = counts.selectExpr("State", "unsolved", f"stack({len(WEAPON_KEY)}, {values}) AS (weapon, count)")
    share = percent(F.col("count"), F.col("unsolved"))
    return long.select("State", "weapon", "count", share.alias("pct_of_unsolved"))


def top_weapon(weapons: DataFrame) -> DataFrame:
    """Weapon with the most unsolved cases per state, ties kept."""
    return _leaders(weapons, "count").select("State", "weapon", "count")


# --- unsolved cases by place ----------------------------------------------------------------------------


def county_unsolved(df: DataFrame, years: Years = None) -> DataFrame:
    """Unsolved cases and victims per county label.

    ``VicCount`` counts the victims beyond the first, so a case has ``VicCount + 1``; cells carry the sum
    in a ``victims`` column.
    """
    rows = unsolved_rows(df, years)
    victims = F.col("victims") if "victims" in df.columns else F.col("VicCount").cast("bigint") + 1
    return rows.groupBy("State", F.col("CNTYFIPS").alias("county")).agg(
        F.sum(weight(df)).alias("unsolved"), F.sum(victims).alias("victims")
    )


def county_unsolved_map(
    df: DataFrame, counties: DataFrame, states: DataFrame, years: Years = None
) -> DataFrame:
    """All county boundaries of every state with their unsolved cases, null where there are none.

    Totals are counted per label and placed by code, within the state of the report.
    """
    totals = count_by_label(unsolved_rows(df, years), "State")
    named = counties.join(states, F.col("STATEFP") == F.col("st_fips")).select("State_Name", "GEOID", "geometry")
    here = (F.col("GEOID") == F.col("county_fips")) & (F.col("State_Name") == F.col("State"))
    mapped = named.join(totals, here, "left")
    return mapped.select("State_Name", "GEOID", F.col("total").alias("unsolved"), "geometry").distinct()


def top_counties(by_county: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` counties with the most unsolved cases per state, equal counts by name.

    A missing county name takes up one of the ``k`` places and is removed afterwards.
    """
    order = Window.partitionBy("State").orderBy(F.col("unsolved").desc(), F.col("county").asc_nulls_last())
    placed = by_county.select("State", "county", "unsolved", F.row_number().over(order).alias("place"))
    return placed.filter((F.col("place") <= k) & F.col("county").isNotNull())


def all_counties_table(by_county: DataFrame) -> DataFrame:
    """Every county and its unsolved cases."""
    return by_county.select("State", "county", "unsolved")


def county_year_counts(df: DataFrame, max_year: int | None = None) -> DataFrame:
    """Unsolved cases per county and recent year, as rows."""
    rows = unsolved_rows(recent_rows(df, max_year), None)
    return rows.groupBy("State", F.col("CNTYFIPS").alias("county"), "Year").agg(
        F.sum(weight(rows)).alias("unsolved")
    )


def county_by_year(
    df: DataFrame,
    max_year: int | None = None,
    last_year: int | None = None,
    missing_county: str | None = None,
    seen: tuple[int | None, int | None] | None = None,
) -> DataFrame:
    """:func:`county_year_counts` with one column per year (``y2017`` ...), absent years 0, and the row total.

    There is no upper year limit, so the columns run to the last year of the data. Unless ``last_year`` or ``seen``, the
    data's first and last year, is given, one aggregate over ``df`` finds them first, so give cells rather than rows.
    ``missing_county`` names a county without a name.
    """
    if max_year is None or last_year is None:
        first, last = seen or df.agg(F.min("Year"), F.max("Year")).first()
        last_year = last if last_year is None else last_year
        first_year = first if max_year is None else max_year - RECENT_YEARS
    else:
        first_year = max_year - RECENT_YEARS
    counts = county_year_counts(df, max_year)
    years = range(first_year, last_year + 1) if last_year is not None else ()
    columns = [
        F.expr(f"coalesce(sum(CASE WHEN Year = {year} THEN unsolved END), 0L)").alias(f"y{year}") for year in years
    ]
    wide = counts.groupBy("State", "county").agg(*columns, F.sum("unsolved").alias("unsolved_total"))
    if missing_county is not None:
        wide = wide.fillna(missing_county, ["county"])
    return wide


# --- printed order ----------------------------------------------------------------------------------------


def printed_order(table: str) -> list[Column]:
    """How a table's rows follow each other within a state; nothing for tables in no particular order."""
    by_name = F.col("county").asc_nulls_last() if table != "weapons" else F.col("weapon")
    first = {
        "weapons": F.col("pct_of_unsolved").desc(),
        "all_counties": F.col("unsolved").desc(),
        "county_by_year": F.col("unsolved_total").desc(),
        "top_counties": F.col("place"),
    }
    return [first[table], by_name] if table in first else []


def with_place(df: DataFrame, table: str) -> DataFrame:
    """The row's place in the printed order, from 1 in each state; a state has a row per label or county."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("State").orderBy(*printed_order(table))))


# --- narrative --------------------------------------------------------------------------------------------


def _leading(totals: dict[str, Column], prefix: str) -> list[Column]:
    """The names with the largest total, by name and joined by a comma, and that total."""
    most = F.greatest(*totals.values())
    names = [F.when(total == most, F.lit(name)) for name, total in sorted(totals.items())]
    return [F.array_join(F.array(*names), ", ").alias(f"{prefix}_name"), most.alias(f"{prefix}_count")]


def report_facts(overview: DataFrame, counts: DataFrame) -> DataFrame:
    """The figures quoted in a report's text, one row per state.

    Cases, unsolved cases and clearance rate from :func:`case_overview`; the race, sex and weapon with the
    most unsolved cases from the one row a state has in :func:`unsolved_counts` (ties joined by a comma).
    """
    total = lambda keys: reduce(lambda a, b: a + b, (F.col(key) for key in keys))
    races = {race: total(PERSON_KEY[sex, race] for sex in SEXES) for race in RACES}
    sexes = {sex: total(PERSON_KEY[sex, race] for race in RACES) for sex in SEXES}
    weapons = {WEAPONS[label]: F.col(key) for label, key in WEAPON_KEY.items()}
    leaders = counts.select(
        "State", *_leading(races, "top_race"), *_leading(sexes, "top_sex"), *_leading(weapons, "top_weapon")
    )
    return overview.select("State", "homi_count", "unsolved", "clear_rate").join(leaders, "State", "left")


def with_year_limits(df: DataFrame, facts: DataFrame, years: Years = None) -> DataFrame:
    """Adds the first and last year of the report: the range asked for, or else each state's own."""
    if years is not None:
        return facts.withColumns({"min_year": F.lit(years[0]), "max_year": F.lit(years[1])})
    return facts.join(state_year_range(df), "State", "left")


# --- cells ------------------------------------------------------------------------------------------------


def year_class(years: tuple[int, int]) -> Column:
    """First year of the year's class, for a report over ``years``.

    A report only asks whether a year lies in its range and whether it is recent. Years that answer alike
    may be counted together, which leaves three classes instead of one group per year.
    """
    first, last = years
    older, newer = sorted((first, last - RECENT_YEARS))
    year = F.col("Year")
    return F.when(year > last, last + 1).when(year >= newer, newer).when(year >= older, older)


def people_cells(df: DataFrame, years: Years = None) -> DataFrame:
    """Cases per combination of the person and weapon columns: enough for every table not about places.

    With ``years``, years are combined by :func:`year_class` and serve reports over that range only.
    """
    return cells(df if years is None else df.withColumn("Year", year_class(years)), *PEOPLE_KEYS)


def place_cells(df: DataFrame) -> DataFrame:
    """Cases and victims per county, code, year and outcome: enough for every table about places."""
    victims = F.col("victims") if "victims" in df.columns else F.col("VicCount").cast("bigint") + 1
    return df.groupBy(*PLACE_KEYS).agg(F.sum(weight(df)).alias(WEIGHT), F.sum(victims).alias("victims"))
