"""CSV with line breaks in quotes, against Spark's reader that gives a file to one task."""

import random
from contextlib import contextmanager

import pytest
from hypothesis import Phase, given, settings, strategies as st

from tallywick.sources import quoted, tables

SCHEMA = "a string, b string, n int"


@contextmanager
def splits_of(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(size))
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def _field(draw):
    text = "".join(draw.choice(["x", "é", " ", ",", '"', "\n", "\r\n", "NA", "long text "]) for _ in range(draw.randint(0, 6)))
    if draw.random() < 0.3:
        return draw.choice(["plain", "", "NA", "12"])
    return '"' + text.replace('"', '""') + '"'


def _content(seed, rows, end="\n"):
    draw = random.Random(seed)
    lines = ["a,b,n"] + [f"{_field(draw)},{_field(draw)},{draw.choice(['1', '', 'x', '77'])}" for _ in range(rows)]
    return end.join(lines) + draw.choice(["", end])


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def _plain(spark, path, problems=None):
    schema = SCHEMA if problems is None else f"{SCHEMA}, {problems} string"
    options = {"columnNameOfCorruptRecord": problems} if problems else {}
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True, enforceSchema=False, nullValue="NA", **options)


@pytest.mark.parametrize("size", [7, 61, 1 << 20])
def test_breaks_at_the_borders_of_ranges(spark, tmp_path, size):
    for seed in range(2):
        (tmp_path / f"f{seed}.csv").write_text(_content(seed, 25), newline="")
    want = _rows(_plain(spark, str(tmp_path)))
    with splits_of(spark, size):
        got = quoted.read_quoted(spark, str(tmp_path), SCHEMA, nullValue="NA")
        assert _rows(got) == want
        if size < 500:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3  # more than a task per file


def test_carriage_returns_and_problems(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b,n\r\n1,"x\r\ny",5\r\n"q\r\n\r\nr",2,no\r\n\r\n3,4\r\n5,6,7,8', newline="")
    with splits_of(spark, 8):
        got = quoted.read_quoted(spark, str(tmp_path), SCHEMA, problems="bad", nullValue="NA").cache().collect()
    rows = sorted((r.a, r.b, r.n, r.bad is not None) for r in got)
    assert rows == [("1", "x\ny", 5, False), ("3", "4", None, True), ("5", "6", 7, True), ("q\n\nr", "2", None, True)]


def test_a_record_longer_than_many_ranges(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(300))
    (tmp_path / "f.csv").write_text(f'a,b,n\n"{long}",x,1\n"short",y,2\n')
    with splits_of(spark, 100):
        got = quoted.read_quoted(spark, str(tmp_path), SCHEMA).collect()
    assert sorted((r.a, r.b, r.n) for r in got) == sorted([(long, "x", 1), ("short", "y", 2)])


def test_headers(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "f.csv").write_text('"a","b\n","n"\n1,2,3\n')
    with splits_of(spark, 4), pytest.raises(Exception, match="header"):
        quoted.read_quoted(spark, str(tmp_path / "ok"), SCHEMA).collect()
    (tmp_path / "ok" / "f.csv").write_text('"a","b","n"\n')
    with splits_of(spark, 4):
        assert quoted.read_quoted(spark, str(tmp_path / "ok"), SCHEMA).collect() == []
    (tmp_path / "ok" / "f.csv").write_text("x,b,n\n1,2,3\n")
    with pytest.raises(Exception, match="header"):
        quoted.read_quoted(spark, str(tmp_path / "ok"), SCHEMA).collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("a,b,n\n1,2,3")
    got = quoted.read_quoted(spark, str(tmp_path), SCHEMA).collect()
    assert [tuple(r) for r in got] == [("1", "2", 3)]


@settings(max_examples=8, deadline=None, phases=[Phase.generate])  # shrinking would run jobs for minutes
@given(st.integers(0, 10**6), st.integers(5, 90), st.sampled_from(["\n", "\r\n"]))
def test_any_content_and_split(spark, tmp_path_factory, seed, size, end):
    folder = tmp_path_factory.mktemp("q")
    (folder / "f.csv").write_text(_content(seed, 15, end), newline="")
    want = _rows(_plain(spark, str(folder)))
    with splits_of(spark, size):
        assert _rows(quoted.read_quoted(spark, str(folder), SCHEMA, nullValue="NA")) == want


def test_cases_with_line_breaks(spark, tmp_path):
    head = "ID,CNTYFIPS,State,Solved,Year,VicAge,VicSex,VicRace,VicCount,OffAge,OffSex,OffRace,Weapon"
    (tmp_path / "c.csv").write_text(f'{head}\n1,"Cook,\nIL",Illinois,Yes,1976,30,Male,White,0,1,Male,White,Rifle\n')
    got = tables.read_cases(spark, str(tmp_path), multi_line=True).collect()
    assert [(r.ID, r.CNTYFIPS, r.Year) for r in got] == [("1", "Cook,\nIL", 1976)]
