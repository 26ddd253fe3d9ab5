"""Survey files: a hand-made one against its CSV export, ranges of any size, and what is written against what was given."""

import math
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywick import schemas
from tallywick.sources import survey, tables
from tallywick.sources.ranges import open_range

CSV = """ID,CNTYFIPS,State,Solved,Year,VicAge,VicSex,VicRace,VicCount,OffAge,OffSex,OffRace,Weapon
A1,"Cook, IL",Illinois,Yes,1976,30,Male,White,0,999,Female,Black,Rifle
A2,NA,Illinois,No,2020,0,Female,Asian,2,NA,Male,White,Drowning
B30000000,"Cook, IL",Ohio,NA,1999,600,Unknown,Black,1,45,Unknown,Unknown,Fire
"""
LABELS = {
    "Solved": ["No", "Yes"], "VicSex": ["Female", "Male", "Unknown"], "VicRace": ["Asian", "Black", "White"],
    "OffSex": ["Female", "Male", "Unknown"], "OffRace": ["Black", "Unknown", "White"], "Weapon": ["Drowning", "Fire", "Rifle"],
}


def _by_hand(order="<"):
    """Three cases of a text of 11 bytes, a labelled number and a plain number, packed; written byte by byte."""
    pack = lambda form, *v: struct.pack(order + form, *v)
    text = [b"$FL2" + b"by hand".ljust(60), pack("5id", 2, 4, 1, 0, 3, 100.0), b"01 Jan 00" + b"00:00:00" + b" " * 64 + b"\0\0\0"]
    text += [pack("6i", 2, 11, 1, 0, 0, 0) + b"NAME    ", pack("i", 5) + b"label\0\0\0", pack("6i", 2, -1, 0, 0, 0, 0) + b" " * 8]
    text += [pack("6i", 2, 0, 0, 1, 0, 0) + b"SEX     " + pack("d", 9.0), pack("6i", 2, 0, 0, 0, 0, 0) + b"AGE     "]
    text += [pack("2i", 3, 2), pack("d", 1.0) + b"\x04Male\0\0\0", pack("d", 2.0) + b"\x06Female\0", pack("3i", 4, 1, 3)]
    text += [pack("2i", 6, 1) + b"a note".ljust(80), pack("4i", 7, 13, 1, 11) + b"NAME=Who is"]
    text += [pack("4i", 7, 99, 8, 1) + b"unknown!", pack("2i", 999, 0)]
    #  name: two elements, one literal and blanks; sex: code; age: missing, fraction, negative
    text += [bytes([253, 254, 101, 255, 253, 253, 102, 253]), b"Ann     ", b"Bartholo", b"m\xc3\xa9     ", pack("d", 0.5)]
    text += [bytes([254, 254, 103, 90, 252, 0, 0, 0])]
    return b"".join(text)


@pytest.mark.parametrize("order", ["<", ">"])
def test_a_file_made_by_hand(spark, tmp_path, order):
    (tmp_path / "hand.sav").write_bytes(_by_hand(order))
    got = survey.read_survey(spark, str(tmp_path))
    assert got.dtypes == [("Who is", "string"), ("SEX", "string"), ("AGE", "double")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("Ann", "Male", None), ("Bartholomé", "Female", 0.5), (None, "3", -10.0)], key=str)
    raw = survey.read_survey(spark, str(tmp_path), labels=False, split=1)
    assert sorted(r["SEX"] for r in raw.collect()) == [1.0, 2.0, 3.0]
    chosen = survey.read_survey(spark, str(tmp_path), "AGE int, none string")
    assert sorted(map(tuple, chosen.collect()), key=str) == [(-10, None), (None, None), (None, None)]  # a half is no int


def test_equals_its_csv_export(spark, tmp_path):
    (tmp_path / "cases.csv").write_text(CSV)
    cases = tables.read_cases(spark, str(tmp_path / "cases.csv"))
    survey.write_survey(cases, str(tmp_path / "survey"), LABELS)
    got = tables.read_survey_cases(spark, str(tmp_path / "survey"))
    assert got.schema.simpleString() == cases.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, cases.collect()), key=str)


NUMBERS = [0.0, 1.0, -99.0, -100.0, 151.0, 152.0, 0.5, 1e300, -1e300, math.inf, float(2**53), None]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("split", [1, 7, 100_000])
def test_ranges_of_any_size(spark, tmp_path, packed, split):
    rows = [(f"näme {i}" * (i % 4), NUMBERS[i % len(NUMBERS)], "x" if i % 3 else None, ["low", "high", None][i % 3]) for i in range(101)]
    df = spark.createDataFrame(rows, "a string, b double, c string, d string").repartition(2)
    survey.write_survey(df, str(tmp_path / "s"), {"d": ["low", "high"]}, packed)
    got = survey.read_survey(spark, str(tmp_path / "s"), split=split)
    want = [(a or None, b, c, d) for a, b, c, d in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_ranges_begin_where_groups_do(spark, tmp_path):
    df = spark.range(1_000).select((F.col("id") * 1.5).alias("x"), F.lit("text").alias("t")).coalesce(1)
    survey.write_survey(df, str(tmp_path / "s"))
    path = next((tmp_path / "s").glob("*.sav"))
    with open_range(str(path)) as source:
        found = survey.read_dictionary(source)
        borders = list(survey._borders(source, found, 100))
    assert borders[-1][0] == 1_000 and len({c for c, _, _ in borders}) == 11
    assert all(c * found.elements >= seen for c, _, seen in borders)


def test_no_rows_and_refused_values(spark, tmp_path):
    empty = spark.createDataFrame([], "a string, n int")
    survey.write_survey(empty, str(tmp_path / "none"))
    assert survey.read_survey(spark, str(tmp_path / "none"), "a string, n int").collect() == []
    with pytest.raises(ValueError, match="255"):
        survey.write_survey(spark.createDataFrame([("x" * 256,)], "a string"), str(tmp_path / "wide"))
    with pytest.raises(Exception, match="without a label"):
        survey.write_survey(spark.createDataFrame([("odd",)], "a string"), str(tmp_path / "odd"), {"a": ["even"]})
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.sav").write_bytes(b"PK" + b"\0" * 400)
    with pytest.raises(Exception, match="not a survey file"):
        survey.read_survey(spark, str(tmp_path / "bad")).collect()


def test_packed_cells_come_back(spark):
    rows = pa.record_batch({"t": ["        ", "\x00\x00\x00\x00\x00\x00\xf0?".encode("utf-8").decode(), ""], "n": [None, -0.0, 5e-324]})
    variables = [survey.Variable("t", 16, 0), survey.Variable("n", 0, 2)]
    cells = survey._cells(rows, variables)
    packer = survey._Packer(True)
    data = packer.add(cells) + packer.finish()
    assert survey._elements(data, 9, 100, "<").tobytes() == cells.tobytes()


def test_codes_read_from_survey(spark, tmp_path):
    df = spark.createDataFrame([("1", " 17 031 "), ("2", None)], schemas.CODES)
    survey.write_survey(df, str(tmp_path / "codes"))
    got = tables.read_survey_codes(spark, str(tmp_path / "codes"))
    # blanks before a text stay, blanks behind it are the format's own
    assert sorted(map(tuple, got.collect())) == [("1", " 17 031"), ("2", None)]
