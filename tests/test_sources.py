import pytest

from tallywick import schemas
from tallywick.operators import incidents as inc, report as r
from tallywick.plans.state_report import run_report
from tallywick.session import materialize, scale_settings, scratch_path
from tallywick.sources import tables as t


def names(schema):
    return [field.split()[0] for field in schema.split(", ")]


def test_cases_csv(spark, tmp_path):
    lines = [
        ",".join(names(schemas.CASES)),
        '01,"Cook, IL",Illinois,No,2010,30,Male,White,0,,,,"Handgun - pistol, revolver, etc"',
        "2,,Illinois,Yes,2011,999,Female,Black,1,20,Male,White,Fire",
    ]
    (tmp_path / "cases.csv").write_text("\n".join(lines))
    first, second = sorted(t.read_cases(spark, str(tmp_path / "cases.csv")).collect())
    assert (first.ID, first.CNTYFIPS, first.Weapon, first.OffAge) == ("01", "Cook, IL", "Handgun - pistol, revolver, etc", None)
    assert second.CNTYFIPS is None and second.VicAge == 999


def test_csv_with_other_columns_is_refused(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("CNTYFIPS,ID\n17031,1")
    with pytest.raises(Exception, match="(?i)header|schema"):
        t.read_codes(spark, str(tmp_path / "codes.csv")).collect()


def test_codes_keep_blanks_and_zeros(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("ID,CNTYFIPS\n1, 01 003\n")
    (row,) = t.read_codes(spark, str(tmp_path / "codes.csv")).collect()
    assert row.CNTYFIPS == " 01 003"


def test_state_lookup_with_windows_line_ends(spark, tmp_path):
    (tmp_path / "states.txt").write_bytes(b"State_Name\tst_fips\tAbbrev\r\nAlabama\t01\tAL\r\nNew York\t36\tNY")
    rows = t.read_states(spark, str(tmp_path / "states.txt")).collect()
    assert sorted(map(tuple, rows)) == [("Alabama", "01", "AL"), ("New York", "36", "NY")]


def test_boundaries_pass_through(spark, tmp_path):
    df = spark.createDataFrame([("17031", "17", bytearray(b"\x01\xff"), "x")], schemas.COUNTIES + ", extra string")
    t.save_snapshot(df, str(tmp_path / "c"))
    (row,) = t.read_counties(spark, str(tmp_path / "c")).collect()
    assert bytes(row.geometry) == b"\x01\xff" and "extra" not in row.asDict()
    assert t.read_snapshot(spark, str(tmp_path / "c"), schemas.COUNTIES).count() == 1


def test_snapshot_by_year(spark, incidents, tmp_path):
    df = incidents(*[{"Year": 2000 + i % 4, "State": "Ohio" if i % 2 else "Iowa"} for i in range(40)], {"Year": None})
    path = str(tmp_path / "incidents")
    t.save_incidents(df, path)
    saved = t.read_incidents(spark, path)
    assert saved.count() == 41 and saved.filter("Year IS NULL").count() == 1
    assert sorted(map(str, saved.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    chosen = inc.filter_incidents(saved, (2001, 2002), solved=0, state=["Ohio"])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan and "EqualTo(State,Ohio)" in plan.replace("In(State, [Ohio])", "EqualTo(State,Ohio)")
    assert len(chosen.inputFiles()) == 5 and chosen.count() == 10  # the listing names all files, the scan reads two years


def test_materialize_reads_back_the_same(spark, incidents):
    df = incidents({}, {"VicAge": None})
    assert sorted(map(str, materialize(df, "x").collect())) == sorted(map(str, df.collect()))


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


class Settings(dict):
    """A session's settings without a session."""

    @property
    def conf(self):
        return self


def test_tables_go_below_the_checkpoint_or_warehouse_folder():
    warehouse = {"spark.sql.warehouse.dir": "file:/w"}
    one, other = (scratch_path(Settings(warehouse), "x") for _ in range(2))
    assert one.startswith("file:/w/scratch/tallywick-") and one.endswith("/x") and one != other
    shared = scratch_path(Settings({**warehouse, "spark.checkpoint.dir": "s3://shared/"}), "x")
    assert shared.startswith("s3://shared/tallywick-")


@pytest.fixture(scope="module")
def report_inputs(spark, incidents):
    df = incidents(
        {}, {"Year": 2012, "Solved": "Yes"}, {"State": "Ohio", "CNTYFIPS": "Lake, OH", "county_fips": "39085"},
        {"State": "PAPSP8"}, {"State": None}, {"State": "District of Columbia"},
    )
    counties = spark.createDataFrame([("17031", "17", "a"), ("39085", "39", "b")], "GEOID string, STATEFP string, geometry string")
    states = spark.createDataFrame([("Illinois", "17", "IL"), ("Ohio", "39", "OH")], "State_Name string, st_fips string, Abbrev string")
    return df, counties, states


def test_report_folders(spark, report_inputs, tmp_path):
    tables = run_report(*report_inputs, str(tmp_path / "all"))
    for name in tables:
        states = {row.State for row in t.read_report_table(spark, str(tmp_path / "all"), name).select("State").collect()}
        assert states == {"Illinois", "Ohio"}, name
    facts = {row.State: row for row in t.read_report_table(spark, str(tmp_path / "all"), "facts").collect()}
    assert (facts["Illinois"].min_year, facts["Illinois"].max_year, facts["Illinois"].clear_rate) == (2010, 2012, 50.0)


def test_report_of_chosen_states_as_csv(spark, report_inputs, tmp_path):
    df, counties, states = report_inputs
    counties = counties.withColumn("geometry", counties.geometry.cast("binary"))
    path = str(tmp_path / "one")
    run_report(df, counties, states, path, years=(2009, 2011), format="csv")
    # a second run for one state replaces that state only
    run_report(df.filter("State <> 'Ohio'"), counties, states, path, years=(2009, 2011), only_states=["Illinois"], format="csv")
    back = t.read_report_table(spark, path, "top_counties").collect()
    assert sorted((row.State, row.county, row.unsolved) for row in back) == [
        ("Illinois", "Cook, IL", 1), ("Ohio", "Lake, OH", 1),
    ]
    shapes = t.read_report_table(spark, path, "county_map").collect()
    assert {(row.State, row.geometry) for row in shapes} == {("Illinois", "YQ=="), ("Ohio", "Yg==")}


def test_titles(spark, report_inputs, tmp_path):
    table = r.all_counties_table(r.county_unsolved(report_inputs[0]))
    assert t.with_titles(table, "all_counties").columns == ["State", "County", "Unsolved Homicide Count"]
    run_report(*report_inputs, str(tmp_path / "titled"), years=(2009, 2011), format="csv", titles=True)
    by_year = t.read_report_table(spark, str(tmp_path / "titled"), "county_by_year")
    assert sorted(by_year.columns) == sorted(["County", "2008", "2009", "2010", "2011", "2012", "Unsolved Total", "State"])
    weapons = t.read_report_table(spark, str(tmp_path / "titled"), "weapons")
    assert sorted(weapons.columns) == sorted(["Murder Weapon", "Count", "Percent of Unsolved", "State"])
    # each file has its titles
    folder = next((tmp_path / "titled" / "runs").iterdir()) / "weapons"
    assert spark.read.csv(str(folder), header=True).columns == ["Murder Weapon", "Count", "Percent of Unsolved", "State"]


def test_partitions_grow_with_the_input():
    small, large = scale_settings(10**9), scale_settings(100 * 1024**4)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert large["spark.sql.shuffle.partitions"] == str(100 * 1024**4 // (512 * 1024**2))
    assert small["spark.sql.files.maxPartitionBytes"] == large["spark.sql.files.maxPartitionBytes"]


HEADER = ",".join(names(schemas.CASES))


def _read(spark, tmp_path, *lines, **how):
    (tmp_path / "hand.csv").write_text("\n".join([HEADER, *lines]))
    return {row.ID: row for row in t.read_cases(spark, str(tmp_path / "hand.csv"), **how).collect()}


def test_cases_written_by_hand(spark, tmp_path):
    """Doubled quotes, missing marks, blanks and quoted marks, as spreadsheets write them."""
    rows = _read(
        spark, tmp_path,
        '1,"Cook ""X"", IL",Illinois,No,2010,30,Male,White,0,,,,Fire',
        "2,NA,Illinois,NA,NA,NA,,White,0,NA,NA,NA,NA",
        '3,"NA"," Iowa ",No,2011,1,Male,"",0,1,Male, White ,Fire',
    )
    assert (rows["1"].CNTYFIPS, rows["1"].State, rows["1"].Weapon) == ('Cook "X", IL', "Illinois", "Fire")
    assert [rows["2"][c] for c in ("CNTYFIPS", "Solved", "Year", "VicAge", "VicSex", "OffAge", "Weapon")] == [None] * 7
    assert (rows["3"].CNTYFIPS, rows["3"].VicRace, rows["3"].OffRace, rows["3"].Year) == (None, None, "White", 2011)


def test_line_breaks_in_quotes(spark, tmp_path):
    line = '1,"Cook,\nIL",Illinois,No,2010,30,Male,White,0,,,,Fire'
    rows = _read(spark, tmp_path, line, "2,x,Illinois,No,2010,30,Male,White,0,,,,Fire", multi_line=True)
    assert rows["1"].CNTYFIPS == "Cook,\nIL" and rows["2"].CNTYFIPS == "x" and len(rows) == 2


def test_bad_numbers_are_reported(spark, tmp_path):
    bad, good = "1,x,Illinois,No,20x0,30,Male,White,0,,,,Fire", "2,x,Illinois,No,2010,30,Male,White,0,,,,Fire"
    rows = _read(spark, tmp_path, bad, good, problems="problem")
    assert rows["1"].Year is None and rows["1"].problem == bad
    assert rows["2"].Year == 2010 and rows["2"].problem is None


def test_reports_replace_earlier_ones(spark, incidents, report_inputs, tmp_path):
    """Two runs into one path: nothing of the first is left, in the whole or for the states asked for."""
    _, counties, states = report_inputs
    df = incidents({"Year": 2000, "Weapon": "Rifle"}, {"Year": 2010, "Solved": "Yes"}, {"Year": 2000, "State": "Ohio"})
    for only in (None, ["Illinois"]):
        path = str(tmp_path / ("some" if only else "every"))
        run_report(df, counties, states, path, years=(2000, 2001))
        run_report(df, counties, states, path, years=(2009, 2010), only_states=only)
        weapons = t.read_report_table(spark, path, "weapons")
        assert {row.State for row in weapons.collect()} == (set() if only is None else {"Ohio"})
        facts = t.read_report_table(spark, path, "facts").filter("State = 'Illinois'").collect()
        assert [row.unsolved for row in facts] == [0]


def test_a_run_that_stops_leaves_the_report_of_before(spark, incidents, report_inputs, tmp_path, monkeypatch):
    _, counties, states = report_inputs
    path = str(tmp_path / "report")
    run_report(incidents({"Year": 2010}), counties, states, path)
    before = t.read_report_table(spark, path, "facts").collect()
    written = []

    def stop(table):
        written.append(table)
        if len(written) > 5:
            raise RuntimeError("stopped")
        return []

    with monkeypatch.context() as patched:
        patched.setattr(t, "printed_order", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            run_report(incidents({"Year": 2010}, {"Year": 2011, "Solved": "Yes"}), counties, states, path)
    assert t.read_report_table(spark, path, "facts").collect() == before
    assert len(t.Published(path).unused()) == 1
    run_report(incidents({"Year": 2012}), counties, states, path, only_states=["Illinois"])
    after = t.read_report_table(spark, path, "county_by_year").collect()
    assert [(row.y2012, row.unsolved_total) for row in after] == [(1, 1)]
    with pytest.raises(ValueError, match="no report"):
        t.read_report_table(spark, str(tmp_path / "nothing"), "facts")


def test_no_report_for_places_without_one(spark, report_inputs, tmp_path):
    df, counties, states = report_inputs
    counties = counties.unionByName(spark.createDataFrame([("11001", "11", "c")], counties.schema))
    states = states.unionByName(spark.createDataFrame([("District of Columbia", "11", "DC")], states.schema))
    run_report(df, counties, states, str(tmp_path))
    assert {row.State for row in t.read_report_table(spark, str(tmp_path), "county_map").collect()} == {"Illinois", "Ohio"}


def test_files_are_in_printed_order(spark, incidents, report_inputs, tmp_path):
    _, counties, states = report_inputs
    rows = [{"CNTYFIPS": f"c{i:02d}", "Weapon": ["Fire", "Rifle", "Poison - does not include gas"][i % 3 if i % 2 else 0]} for i in range(9) for _ in range(1 + i * 7 % 5)]
    run_report(incidents(*rows), counties, states, str(tmp_path), titles=True, format="csv")
    weapons = [row["Percent of Unsolved"] for row in t.read_report_table(spark, str(tmp_path), "weapons").collect()]
    assert weapons == sorted(weapons, reverse=True) and weapons[0] > weapons[1]
    listed = [(-row["Unsolved Homicide Count"], row.County) for row in t.read_report_table(spark, str(tmp_path), "all_counties").collect()]
    assert listed == sorted(listed) and len(listed) == 9
    mapped = t.read_report_table(spark, str(tmp_path), "county_map")
    assert "County Unsolved" in mapped.columns
