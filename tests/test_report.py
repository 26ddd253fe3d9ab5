import pytest

from conftest import dicts
from tallywick.domains import CHART_RACE, RACES, SEXES, WEAPONS
from tallywick.operators import report as r

YEARS = (2005, 2015)


@pytest.fixture(scope="module")
def cases(incidents):
    return incidents(
        {"VicRace": "Black", "VicSex": "Female", "Weapon": "Fire", "VicCount": 2},
        {"VicRace": "Black", "VicSex": "Male", "OffSex": "Unknown"},
        {"VicRace": "White", "VicSex": "Unknown", "CNTYFIPS": "Lake, IL", "county_fips": "17097"},
        {"VicRace": "Unknown", "VicSex": "Male", "Solved": "Yes"},
        {"VicRace": "White", "Solved": "Yes"},
        {"VicRace": "Other", "VicSex": "Other", "Weapon": "Unlisted", "CNTYFIPS": None},
        {"Solved": "Unknown"},
        {"Year": 2004},
        {"Year": 2016, "CNTYFIPS": "Will, IL"},
        {"Year": 2013, "CNTYFIPS": "Will, IL"},
        {"State": "Ohio", "Solved": "Yes", "VicRace": "Asian"},
        {"State": "Ohio", "Solved": "Unknown", "VicRace": "Black"},
    ).cache()


def by_state(df, state="Illinois"):
    return [row for row in dicts(df) if row["State"] == state]


def test_overview(cases):
    (il,) = by_state(r.case_overview(cases, YEARS))
    # unsolved: two Black, one White, one other, one of 2013
    assert il == {
        "State": "Illinois", "unsolved": 5, "solved": 2, "homicide_total": 8, "homi_count": 7, "clear_rate": 28.57,
    }
    (oh,) = by_state(r.case_overview(cases, YEARS), "Ohio")
    assert (oh["unsolved"], oh["clear_rate"], oh["homi_count"], oh["homicide_total"]) == (0, 100.0, 1, 2)


def test_no_decided_case_has_no_rate(incidents):
    (row,) = r.case_overview(incidents({"Solved": "Unknown"})).collect()
    assert row.homi_count == 0 and row.clear_rate is None


def test_outcome_long_repeats_the_overview(cases):
    overview = r.case_overview(cases, YEARS)
    wide = {(row.State, name): row[name.lower()] for row in overview.collect() for name in ("Unsolved", "Solved")}
    long = r.outcome_long(overview).collect()
    assert {(row.State, row.case_outcome): row.total for row in long} == wide
    assert {row.x for row in long} == {"Homicide Cases"}


def test_sexes(cases):
    (il,) = by_state(r.victim_sex_counts(cases, YEARS))
    assert (il["female"], il["male"], il["unknown"]) == (1, 5, 1)
    long = {row["offender_sex"]: row["total"] for row in by_state(r.offender_sex_long(r.offender_sex_counts(cases, YEARS)))}
    assert long == {"Male": 7, "Female": 0, "Sex Unknown": 1}
    assert {row["victim_sex"] for row in by_state(r.victim_sex_long(r.victim_sex_counts(cases)))} == set(SEXES)


def test_unsolved_counts(cases):
    (il,) = r.unsolved_counts(cases, YEARS).collect()  # a state without unsolved cases has no row
    assert len(il) == 2 + 3 + 6 + 18 + 17
    assert (il.unsolved, il.female, il.male) == (5, 1, 2)
    assert il.unknown == il.unknown_race == 0  # counts races, and the one unknown sex is white
    assert (il.black, il.white, il.female_black, il.male_white, il.unknown_white) == (2, 2, 1, 1, 1)
    assert (il.weapon_fire, il.weapon_rifle, il.weapon_handgun) == (1, 3, 0)


def test_unknown_counts_the_race(incidents):
    (row,) = r.unsolved_counts(incidents({"VicRace": "Unknown", "VicSex": "Male"})).collect()
    assert (row.unknown, row.unknown_race, row.male_unknown_race, row.unknown_unknown_race) == (1, 1, 1, 0)


def test_null_labels(incidents):
    df = incidents({"VicSex": None, "VicRace": "White"}, {"VicSex": "Female", "VicRace": None}, {"Weapon": None})
    (loose,) = r.unsolved_counts(df).collect()
    assert (loose.male, loose.female, loose.white, loose.male_white) == (1, 1, 2, 1)
    (strict,) = r.unsolved_counts(df, strict_na=True).collect()
    assert strict.male is None and strict.white is None and strict.weapon_fire is None
    assert strict.male_white is None  # undecided for the white victim of unknown sex
    assert strict.female_black is None  # and for the female victim of unknown race
    assert strict.male_black == 0  # never undecided: every null meets a false
    (plain,) = r.unsolved_counts(incidents({}), strict_na=True).collect()
    assert (plain.male, plain.male_white, plain.weapon_rifle) == (1, 1, 1)
    (overview,) = r.case_overview(incidents({"Solved": None}, {}), strict_na=True).collect()
    assert overview.unsolved is None and overview.clear_rate is None and overview.homicide_total == 2


def test_solve_rates(cases):
    rates = {row["VicRace"]: (row["unsolved"], row["solved"], row["solve_rate"]) for row in by_state(r.solve_rate_by_race(cases, YEARS))}
    assert rates["White"] == (2, 1, 33.33)
    assert rates["Unknown"] == (0, 1, 100.0)
    assert rates["Black"] == (2, 0, 0.0)
    (black,) = [row for row in by_state(r.solve_rate_by_race(cases, YEARS), "Ohio") if row["VicRace"] == "Black"]
    assert (black["unsolved"], black["solved"], black["solve_rate"]) == (0, 0, None)


def test_race_by_sex(cases):
    counts = r.unsolved_counts(cases, YEARS)
    long = r.unsolved_race_sex(counts)
    rows = long.collect()
    assert len(rows) == 18 and sum(row["count"] for row in rows) == 4  # the other label is in no cell
    assert {(row.race, row.sex) for row in rows} == {(a, b) for a in RACES for b in SEXES}
    assert {row.chart_race for row in rows} == {CHART_RACE.get(a, a) for a in RACES}
    wide = {row.race: row for row in r.unsolved_race_sex_wide(long).collect()}
    assert len(wide) == 6
    assert (wide["Black"].female, wide["Black"].male, wide["Black"].unknown, wide["Black"].total) == (1, 1, 0, 2)
    assert wide["Black"].pct_of_unsolved == 50.0 and wide["Asian"].pct_of_unsolved == 0.0
    assert abs(sum(row.pct_of_unsolved for row in wide.values()) - 100) < 0.1


def test_no_known_person_has_no_share(incidents):
    long = r.unsolved_race_sex(r.unsolved_counts(incidents({"VicRace": "Other"})))
    assert {row.pct_of_unsolved for row in r.unsolved_race_sex_wide(long).collect()} == {None}


def test_leaders_keep_ties(cases):
    counts = r.unsolved_counts(cases, YEARS)
    long = r.unsolved_race_sex(counts)
    tops = r.top_race(r.unsolved_race_sex_wide(long)).collect()
    assert sorted((t.race, t.total) for t in tops) == [("Black", 2), ("White", 2)]
    assert [(t.sex, t.total) for t in r.top_sex(long).collect()] == [("Male", 2)]
    assert [(t.weapon, t["count"]) for t in r.top_weapon(r.unsolved_weapons(counts)).collect()] == [("Rifle", 3)]


def test_weapons(cases):
    weapons = r.unsolved_weapons(r.unsolved_counts(cases, YEARS))
    rows = sorted(r.with_place(weapons, "weapons").collect(), key=lambda row: (row.State, row.place))
    assert [row.weapon for row in rows[:3]] == ["Rifle", "Fire", "Asphyxiation - includes death by gas"]
    assert [row.pct_of_unsolved for row in rows[:3]] == [60.0, 20.0, 0.0]
    assert {row.weapon for row in rows} == set(WEAPONS.values()) and len(rows) == 17


def test_counties(cases):
    table = r.county_unsolved(cases, YEARS)
    got = {row.county: (row.unsolved, row.victims) for row in table.collect()}
    assert got == {"Cook, IL": (2, 4), "Lake, IL": (1, 1), "Will, IL": (1, 1), None: (1, 1)}
    placed = r.with_place(r.all_counties_table(table), "all_counties").orderBy("place")
    ordered = [row.county for row in placed.collect()]
    assert ordered == ["Cook, IL", "Lake, IL", "Will, IL", None]


def test_top_counties_null_takes_a_place(incidents):
    names = [f"c{i:02d}" for i in range(12)]
    rows = [{"CNTYFIPS": n} for n in names for _ in range(2)] + [{"CNTYFIPS": None}] * 3
    top = r.top_counties(r.county_unsolved(incidents(*rows))).collect()
    # the missing name is first; of twelve equal counties the first nine by name remain
    assert sorted((t.place, t.county) for t in top) == list(zip(range(2, 11), names[:9]))
    assert len(r.top_counties(r.county_unsolved(incidents(*rows)), k=3).collect()) == 2


def test_county_map_keeps_empty_counties(spark, cases):
    counties = spark.createDataFrame(
        [("17031", "17", "a"), ("17097", "17", "b"), ("17999", "17", "c"), ("39001", "39", "d"), ("99001", "99", "e")],
        "GEOID string, STATEFP string, geometry string",
    )
    states = spark.createDataFrame([("Illinois", "17", "IL"), ("Ohio", "39", "OH")], "State_Name string, st_fips string, Abbrev string")
    rows = {(row.State_Name, row.GEOID, row.unsolved) for row in r.county_unsolved_map(cases, counties, states, YEARS).collect()}
    # three labels share the first code: three rows, as each label carries its own total
    assert rows == {
        ("Illinois", "17031", 2), ("Illinois", "17031", 1), ("Illinois", "17097", 1),
        ("Illinois", "17999", None), ("Ohio", "39001", None),
    }


def test_county_map_places_codes_within_the_state(spark, incidents):
    df = incidents({"State": "Ohio"})  # an Ohio case with an Illinois code
    counties = spark.createDataFrame([("17031", "17", "a")], "GEOID string, STATEFP string, geometry string")
    states = spark.createDataFrame([("Illinois", "17", "IL")], "State_Name string, st_fips string, Abbrev string")
    (row,) = r.county_unsolved_map(df, counties, states).collect()
    assert row.unsolved is None


def test_recent_years(cases):
    # four calendar years from max_year - 3 on, and later years too
    (il,) = r.recent_unsolved_counts(cases, 2016).collect()
    assert il.unsolved == 2
    (il,) = r.recent_unsolved_counts(cases, 2014).collect()
    assert il.unsolved == 2
    (il,) = r.recent_unsolved_counts(cases, 2017).collect()
    assert il.unsolved == 1
    # without a year, the state's own last one
    (il,) = r.recent_unsolved_counts(cases).collect()
    assert il.unsolved == 2
    shorts = {row.chart_race for row in r.recent_race_sex(r.recent_unsolved_counts(cases, 2016)).collect()}
    assert "A.I./N.A." in shorts and "A.I./A.N." not in shorts


def test_county_by_year(cases):
    table = r.county_by_year(cases, 2014)
    assert table.columns == ["State", "county"] + [f"y{y}" for y in range(2011, 2017)] + ["unsolved_total"]
    (row,) = table.collect()
    assert (row.county, row.y2013, row.y2014, row.y2016, row.unsolved_total) == ("Will, IL", 1, 0, 1, 2)
    assert r.county_by_year(cases, 2014, last_year=2016).collect() == [row]


def test_county_by_year_without_name(incidents):
    df = incidents({"CNTYFIPS": None}, {"CNTYFIPS": None}, {})
    names = lambda table: [row.county for row in r.with_place(table, "county_by_year").orderBy("place").collect()]
    assert names(r.county_by_year(df, 2010)) == [None, "Cook, IL"]
    assert names(r.county_by_year(df, 2010, missing_county="0")) == ["0", "Cook, IL"]
    whole = r.county_by_year(df).columns
    assert whole == ["State", "county", "y2010", "unsolved_total"]


def test_facts(cases):
    facts = r.with_year_limits(cases, r.report_facts(r.case_overview(cases, YEARS), r.unsolved_counts(cases, YEARS)), YEARS)
    (il,) = by_state(facts)
    assert il == {
        "State": "Illinois", "homi_count": 7, "unsolved": 5, "clear_rate": 28.57, "min_year": 2005, "max_year": 2015,
        "top_race_name": "Black, White", "top_race_count": 2, "top_sex_name": "Male", "top_sex_count": 2,
        "top_weapon_name": "Rifle", "top_weapon_count": 3,
    }
    (oh,) = by_state(facts, "Ohio")
    assert oh["top_race_name"] is None and oh["unsolved"] == 0


def test_own_year_limits(cases):
    facts = r.with_year_limits(cases, r.report_facts(r.case_overview(cases), r.unsolved_counts(cases)))
    assert {row.State: (row.min_year, row.max_year) for row in facts.collect()} == {"Illinois": (2004, 2016), "Ohio": (2010, 2010)}


@pytest.mark.parametrize(
    "table",
    [
        r.case_overview, r.victim_sex_counts, r.offender_sex_counts, r.unsolved_counts, r.solve_rate_by_race,
        r.recent_unsolved_counts,
    ],
)
def test_cells_give_the_same_people_tables(cases, table):
    assert sorted(map(str, table(r.people_cells(cases)).collect())) == sorted(map(str, table(cases).collect()))


@pytest.mark.parametrize("table", [r.county_unsolved, r.county_year_counts, r.county_by_year])
def test_cells_give_the_same_place_tables(cases, table):
    places = r.place_cells(cases)
    assert sorted(map(str, table(places).collect())) == sorted(map(str, table(cases).collect()))
    again = r.place_cells(places)
    assert sorted(map(str, table(again).collect())) == sorted(map(str, table(cases).collect()))


def test_one_state_alone_equals_its_part_of_all(cases):
    one = cases.filter("State = 'Illinois'")
    for table in (r.case_overview, r.unsolved_counts, r.solve_rate_by_race, r.county_unsolved):
        alone = sorted(map(str, table(one, YEARS).collect()))
        together = sorted(str(row) for row in table(cases, YEARS).collect() if row.State == "Illinois")
        assert alone == together


def test_invariants(cases):
    counts = r.unsolved_counts(cases, YEARS)
    (row,) = counts.collect()
    assert sum(row[key] for key in r.PERSON_KEY.values()) <= row.unsolved
    assert sum(c.unsolved for c in r.county_unsolved(cases, YEARS).collect()) == row.unsolved
