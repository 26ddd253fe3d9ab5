"""Random small tables against plain Python."""

from collections import Counter

import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallywick.operators import breaks, incidents as inc, prices, report

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

LABELS = st.sampled_from(["a", "b", "c", None])
CODES = st.sampled_from(["01", "02", "03", None])


@few
@given(st.lists(st.tuples(LABELS, CODES), max_size=40))
def test_county_totals(spark, incidents, rows):
    df = incidents(*[{"CNTYFIPS": a, "county_fips": b} for a, b in rows])
    per_label = Counter(a for a, _ in rows)
    got = [(r.CNTYFIPS, r.county_fips, r.county_total) for r in inc.county_totals(df).collect()]
    assert sorted(got, key=str) == sorted(((a, b, per_label[a]) for a, b in set(rows)), key=str)
    assert sum(report.county_unsolved(df).select("unsolved").toPandas()["unsolved"].tolist()) == len(rows)


@few
@given(
    st.lists(st.tuples(st.sampled_from(["1", "2", "3", "4"]), st.integers(0, 9)), max_size=20),
    st.lists(st.tuples(st.sampled_from(["1", "2", "3", "5"]), st.sampled_from([" 0 1", "01", "0 2", None])), max_size=20),
)
def test_code_join(spark, cases, codes):
    df = inc.build_incidents(
        spark.createDataFrame(cases, "ID string, x int"), spark.createDataFrame(codes, "ID string, CNTYFIPS string")
    )
    want = Counter()
    for case, x in cases:
        found = [c if c is None else c.replace(" ", "") for i, c in codes if i == case]
        want.update((case, x, c) for c in found or [None])
    assert Counter(map(tuple, df.collect())) == want


@few
@given(st.dictionaries(st.tuples(st.sampled_from("abc"), st.integers(0, 3000)), st.integers(1, 500), max_size=150))
def test_numbers_and_means(spark, history):
    rows = [(a, dt.date(2000, 1, 1) + dt.timedelta(days=d), float(p)) for (a, d), p in history.items()]
    df = spark.createDataFrame(rows, "asset string, ts date, close double")
    by_asset = {a: sorted((r for r in rows if r[0] == a), key=lambda r: r[1], reverse=True) for a in "abc"}
    numbers = {(r.asset, r.ts): (r.week_number, r.week_count) for r in prices.week_numbers(df).collect()}
    assert numbers == {(r[0], r[1]): (i, len(h)) for h in by_asset.values() for i, r in enumerate(h, 1)}
    for row in prices.latest_averages(df).collect():
        close = [r[2] for r in by_asset[row.asset]]
        assert row.avg_overall == sum(close) / len(close)
        assert row.avg_50 == sum(close[:50]) / len(close[:50]) and row.avg_100 == sum(close[:99]) / len(close[:99])


@few
@given(
    st.lists(st.tuples(st.sampled_from(["x", "y"]), st.sampled_from([f"c{i}" for i in range(6)] + [None])), max_size=60),
    st.integers(1, 7),
)
def test_top_counties(spark, incidents, rows, k):
    df = incidents(*[{"State": s, "CNTYFIPS": c} for s, c in rows])
    want = set()
    for state in "xy":
        counts = Counter(c for s, c in rows if s == state)
        order = sorted(counts, key=lambda c: (-counts[c], c is None, c or ""))
        want |= {(state, c, counts[c], i) for i, c in enumerate(order[:k], 1) if c is not None}
    got = {(r.State, r.county, r.unsolved, r.place) for r in report.top_counties(report.county_unsolved(df), k).collect()}
    assert got == want


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-10**6, 10**6), min_size=2, max_size=5).filter(lambda v: min(v) < max(v)))
def test_cuts(spark, values):
    """Cuts are multiples of one round step, inside the range, and about seven."""
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    cuts = sorted(r.cut for r in breaks.legend_breaks_numeric(df, "x").collect())
    assert all(min(values) <= c <= max(values) for c in cuts) and 3 <= len(cuts) <= 12
    steps = {round(b - a, 6) for a, b in zip(cuts, cuts[1:])}
    assert len(steps) == 1
    step = steps.pop()
    assert f"{step:e}"[0] in "125" and all(abs(c / step - round(c / step)) < 1e-6 for c in cuts)
    # no room for one more on either side
    assert cuts[0] - step < min(values) and cuts[-1] + step > max(values)


@few
@given(st.lists(st.tuples(st.sampled_from(["Yes", "No", "Unknown"]), st.sampled_from(["White", "Black", "Other"])), max_size=40))
def test_rates(spark, incidents, rows):
    df = incidents(*[{"Solved": s, "VicRace": v} for s, v in rows])
    got = {r.VicRace: (r.unsolved, r.solved, r.solve_rate) for r in report.solve_rate_by_race(df).collect()}
    want = {}
    for race in {v for _, v in rows}:
        no, yes = rows.count(("No", race)), rows.count(("Yes", race))
        want[race] = (no, yes, None if no + yes == 0 else yes / (no + yes) * 100)
    assert got.keys() == want.keys()
    for race, (no, yes, rate) in want.items():
        assert got[race][:2] == (no, yes)
        assert (got[race][2] is None) == (rate is None) and (rate is None or abs(got[race][2] - rate) <= 0.00501)
    assert df.filter(F.col("Solved") == "No").count() == sum(no for no, _, _ in want.values())


@few
@given(
    st.lists(st.tuples(st.integers(1995, 2012), st.sampled_from(["Yes", "No"]), st.sampled_from(["Male", "Female"])), max_size=60),
    st.integers(1994, 2010),
    st.integers(0, 9),
)
def test_combined_years_answer_like_years(spark, incidents, rows, first, span):
    years = (first, first + span)
    df = incidents(*[{"Year": y, "Solved": s, "VicSex": v} for y, s, v in rows])
    cells = report.people_cells(df, years)
    assert cells.select("Year").distinct().count() <= 4
    for table in (report.case_overview, report.unsolved_counts, report.solve_rate_by_race, report.victim_sex_counts):
        assert sorted(map(str, table(cells, years).collect())) == sorted(map(str, table(df, years).collect()))
    recent = [report.recent_unsolved_counts(x, years[1]).collect() for x in (cells, df)]
    assert recent[0] == recent[1]
