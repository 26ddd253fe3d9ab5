import itertools

import pytest
from pyspark.sql import functions as F

from conftest import CASE, dicts
from tallywick.domains import ALL, SOLVED, UNSOLVED
from tallywick.operators import incidents as inc
from tallywick.plans.county_map import MapRequest, is_valid, run_map, year_limits
from tallywick.sources import survey, tables

COUNTIES = [("17031", "17", "g1"), ("17043", "17", "g2"), ("18001", "18", "g3"), ("99001", "99", "g4")]
STATES = [("Illinois", "17", "IL"), ("Indiana", "18", "IN")]


@pytest.fixture(scope="module")
def lookups(spark):
    counties = spark.createDataFrame(COUNTIES, "GEOID string, STATEFP string, geometry string")
    return counties, spark.createDataFrame(STATES, "State_Name string, st_fips string, Abbrev string")


def test_codes_join_on_id(spark):
    case = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), (None, "d")], "ID string, x string")
    codes = spark.createDataFrame(
        [("1", " 17 031"), ("3", "18001"), ("3", "18 001"), ("3", "18 003"), ("9", "1"), (None, "2")],
        "ID string, CNTYFIPS string",
    )
    got = sorted((r.x, r.county_fips) for r in inc.build_incidents(case, codes).collect() if r.x != "b" and r.x != "d")
    # one row per code row, copies included
    assert got == [("a", "17031"), ("c", "18001"), ("c", "18001"), ("c", "18003")]
    left = [(r.x, r.county_fips) for r in inc.build_incidents(case, codes).collect() if r.x in "bd"]
    assert sorted(left) == [("b", None), ("d", None)]


def test_many_copies_of_a_code_row(spark):
    """More copies than one array may hold come back one by one."""
    codes = spark.range(25_003).selectExpr("'hot' AS ID", "'17031' AS CNTYFIPS")
    case = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "ID string, x int")
    counts = {r.x: r["count"] for r in inc.build_incidents(case, codes).groupBy("x").count().collect()}
    assert counts == {1: 25_003, 2: 25_003, 3: 1}


def rows_for_filters(incidents):
    picks = itertools.product(["Yes", "No", "Unknown"], ["Rifle", "Fire"], ["Illinois", "Indiana"],
                              [("Female", "White", 0), ("Male", "Black", 15)], [("Male", "Asian", 25), ("Female", "White", 999)])
    return [
        {"Solved": s, "Weapon": w, "State": st, "VicSex": v[0], "VicRace": v[1], "VicAge": v[2],
         "OffSex": o[0], "OffRace": o[1], "OffAge": o[2]}
        for s, w, st, v, o in picks
    ] + [{"Year": 1999}, {"Weapon": None}, {"VicAge": 600}, {"State": None}]


def test_all_48_filter_combinations(incidents):
    """Three outcomes by four switches, against the rule applied row by row."""
    rows = [{**CASE, **row, "ID": str(i)} for i, row in enumerate(rows_for_filters(incidents))]
    df = incidents(*rows).cache()
    weapon, state = ["Rifle"], ["Indiana"]
    victim = {"sex": ["Female"], "race": ["White"], "age": ["<1", "1-9"]}
    offender = {"sex": ["Male"], "race": ["Asian"], "age": ["20-29"]}
    seen = set()
    for solved, w, s, v, o in itertools.product((SOLVED, UNSOLVED, ALL), *[(False, True)] * 4):
        want = {
            r["ID"] for r in rows
            if 2000 <= r["Year"] <= 2015
            and (solved == ALL or r["Solved"] == {1: "Yes", 0: "No"}[solved])
            and (not w or r["Weapon"] == "Rifle")
            and (not s or r["State"] == "Indiana")
            and (not v or (r["VicSex"], r["VicRace"]) == ("Female", "White") and 0 <= r["VicAge"] < 10)
            and (not (o and solved == SOLVED) or (r["OffSex"], r["OffRace"]) == ("Male", "Asian") and 20 <= r["OffAge"] < 30)
        }
        got = inc.filter_incidents(
            df, (2000, 2015), solved=solved, weapon=weapon if w else None, state=state if s else None,
            victim=victim if v else None, offender=offender if o else None,
        )
        assert {r.ID for r in got.collect()} == want
        seen.add((solved, w, s, v, o))
    assert len(seen) == 48


def test_an_empty_choice_lets_nothing_through(incidents):
    assert inc.filter_incidents(incidents({}), (2000, 2020), weapon=[]).count() == 0


def test_domains(incidents, lookups):
    df = incidents({"Year": 1980}, {"VicSex": None, "Year": 2020}, {"Weapon": "Fire"}, {"Weapon": "Fire"})
    got = {}
    for r in inc.filter_domains(df, lookups[1]).collect():
        got.setdefault(r.domain, []).append((r.value, r.first_year, r.last_year))
    assert sorted(v for v, _, _ in got["Weapon"]) == ["Fire", "Rifle"]
    assert {v for v, _, _ in got["VicSex"]} == {"Male", None}
    assert got["Year"] == [(None, 1980, 2020)]
    assert sorted(v for v, _, _ in got["State"]) == ["Illinois", "Indiana"]
    assert len(got["AgeRange"]) == 10


def totals_rows(incidents):
    return incidents(
        {}, {}, {"county_fips": "17043"},  # one label, two codes
        {"CNTYFIPS": None, "county_fips": "18001"}, {"CNTYFIPS": None, "county_fips": None},  # no label
        {"CNTYFIPS": "Lost", "county_fips": "00000"},  # a code without boundary
    )


def test_totals_belong_to_the_label(incidents):
    df = totals_rows(incidents)
    got = {(r.CNTYFIPS, r.county_fips): r.county_total for r in inc.county_totals(df).collect()}
    assert got == {
        ("Cook, IL", "17031"): 3, ("Cook, IL", "17043"): 3, (None, "18001"): 2, (None, None): 2, ("Lost", "00000"): 1,
    }


def test_map_keeps_counties_with_cases_only(incidents, lookups):
    table = inc.county_map(lookups[0], inc.county_totals(totals_rows(incidents)), lookups[1])
    got = dicts(inc.map_labels(table), "GEOID")
    assert [(r["GEOID"], r["State_Name"], r["county_total"], r["label"]) for r in got] == [
        ("17031", "Illinois", 3, "Cook, IL, 3"), ("17043", "Illinois", 3, "Cook, IL, 3"), ("18001", "Indiana", 2, "NA, 2"),
    ]


def test_map_county_without_state_and_repeated_boundary(spark, incidents, lookups):
    counties = lookups[0].union(lookups[0])
    df = incidents({"county_fips": "99001"})
    (row,) = inc.county_map(counties, inc.county_totals(df), lookups[1]).collect()
    assert row.State_Name is None and row.GEOID == "99001"


def test_map_with_opaque_geometry(spark, incidents, lookups):
    counties = lookups[0].selectExpr("GEOID", "STATEFP", "cast(geometry AS binary) AS geometry")
    (row,) = inc.county_map(counties, inc.county_totals(incidents({})), lookups[1]).collect()
    assert bytes(row.geometry) == b"g1"


@pytest.mark.parametrize(
    "request_, valid",
    [
        (MapRequest((2005, 2010)), True),
        (MapRequest((2010, 2005)), False),
        (MapRequest((1999, 2010)), False),
        (MapRequest((2005, 2021)), False),
        (MapRequest((2005, 2010), weapon=[]), False),
        (MapRequest((2005, 2010), weapon=["Rifle"]), True),
        (MapRequest((2005, 2010), weapon=["Rifle"], state=[""]), False),
        (MapRequest((2005, 2010), state=["Illinois"]), True),
    ],
)
def test_request_check(incidents, lookups, request_, valid):
    df = incidents({"Year": 2000}, {"Year": 2020}, {})
    limits = year_limits(df)
    assert limits == (2000, 2020)
    assert is_valid(request_, limits) is valid
    table = run_map(df, *lookups, request_, limits)
    assert table.count() == (1 if valid else 0)
    assert {"label", "position", "county_total"} <= set(table.columns)


def test_states_with_a_report(incidents):
    names = ["Illinois", "Illinois", "District of Columbia", "PAPSP8", None, "Ohio"]
    df = incidents(*[{"State": s, "Year": 2000 + i} for i, s in enumerate(names)])
    assert sorted(r.State for r in inc.report_states(df).collect()) == ["Illinois", "Ohio"]
    years = {r.State: (r.min_year, r.max_year) for r in inc.state_year_range(df).collect()}
    assert years["Illinois"] == (2000, 2001) and years["Ohio"] == (2005, 2005)


@pytest.mark.parametrize("years, valid", [((2005, 2010), True), ((2004, 2010), False), ((2005, 2011), False), ((2010, 2005), False)])
def test_limits_found_in_the_same_job(incidents, lookups, years, valid):
    df = incidents({"Year": 2005}, {"Year": 2010})
    table = run_map(df, *lookups, MapRequest(years))
    assert (table.count() > 0) == valid


def test_cases_and_codes_move_once(spark, incidents):
    codes = spark.createDataFrame([("1", " 17 031 "), ("1", "17043"), (None, "99999")], "ID string, CNTYFIPS string")
    cases = incidents({"ID": "1"}, {"ID": "2"}, {"ID": None}).drop("county_fips")
    built = inc.build_incidents(cases, codes)
    assert sorted((r.ID or "", r.county_fips or "") for r in built.collect()) == [("", ""), ("1", "17031"), ("1", "17043"), ("2", "")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = inc.build_incidents(cases, codes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(ID") == 2 and plan.count("Exchange") == 2


def test_cases_without_an_id_go_to_several_tasks(spark):
    cases = spark.range(400).select(F.lit(None).cast("string").alias("ID"), F.col("id").alias("x"))
    codes = spark.createDataFrame([(None, "99 999"), ("1", "17 031")], "ID string, CNTYFIPS string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = inc.build_incidents(cases, codes).select("x", "county_fips", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(r.x for r in got) == list(range(400)) and {r.county_fips for r in got} == {None}
    assert len({r.task for r in got}) > 1


def test_codes_from_survey_files_are_not_broadcast(spark, tmp_path):
    codes = spark.range(300).select(F.col("id").cast("string").alias("ID"), F.lit("17 031").alias("CNTYFIPS"))
    survey.write_survey(codes, str(tmp_path / "codes"))
    cases = spark.range(0, 600, 2).select(F.col("id").cast("string").alias("ID"), F.col("id").alias("x"))
    built = inc.build_incidents(cases, tables.read_survey_codes(spark, str(tmp_path / "codes")))
    assert {(r.x, r.county_fips) for r in built.collect()} == {(i, "17031" if i < 300 else None) for i in range(0, 600, 2)}
    assert "Broadcast" not in built._jdf.queryExecution().executedPlan().toString()
