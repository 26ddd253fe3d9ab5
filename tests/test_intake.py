"""Documents taken in step by step against all at once."""

import json
import os
from datetime import datetime, timezone

import pytest

from tallywick.plans import intake
from tallywick.sources import documents as d
from tallywick.sources.published import Published


def _doc(asset, *bars):
    rows = [[t, "1", "9", "0.5", str(close), "2", "7", 3] for t, close in bars]
    return json.dumps({"error": [], "result": {asset: rows, "last": bars[-1][0] if bars else 0}})


def _land(folder, name, text, at):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def _bars(spark, path):
    return sorted((r.asset, str(r.ts), r.close) for r in intake.taken_rows(spark, path).collect())


Y2020, Y2021 = 1_577_836_800, 1_609_459_200
WEEK = 604_800


def test_two_runs_equal_one(spark, tmp_path):
    steps = [
        [("a1", _doc("A", (Y2020, 1), (Y2020 + WEEK, 2)), 100), ("b1", _doc("B", (Y2020, 5)), 101)],
        [("a2", _doc("A", (Y2020 + WEEK, 3), (Y2021, 4)), 200), ("bad", "no json", 201), ("none", _doc("C"), 202)],
        [],
        [("late", _doc("A", (Y2020 + WEEK, 99)), 150)],  # landed before a2, found later: a2 holds
    ]
    landing, path = tmp_path / "landing", str(tmp_path / "store")
    parsed = []
    for step in steps:
        for name, text, at in step:
            _land(landing, name, text, at)
        parsed.append(intake.take_in(spark, str(landing), path))
    assert [t.documents for t in parsed] == [2, 3, 0, 1]
    assert [t.parts for t in parsed] == [("2020",), ("2020", "2021"), (), ("2020",)]
    whole = str(tmp_path / "whole")
    assert intake.take_in(spark, str(landing), whole).documents == 6
    assert _bars(spark, path) == _bars(spark, whole) == sorted(
        [("A", "2020-01-01 00:00:00", 1.0), ("A", "2020-01-08 00:00:00", 3.0), ("A", "2021-01-01 00:00:00", 4.0), ("B", "2020-01-01 00:00:00", 5.0)]
    )


def test_a_file_written_anew_is_taken_in_again(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "store")
    _land(landing, "a", _doc("A", (Y2020, 1)), 100)
    intake.take_in(spark, str(landing), path)
    _land(landing, "a", _doc("A", (Y2020, 22)), 300)
    assert intake.take_in(spark, str(landing), path).documents == 1
    assert _bars(spark, path) == [("A", "2020-01-01 00:00:00", 22.0)]


def test_a_run_that_stops_has_taken_in_nothing(spark, tmp_path, monkeypatch):
    landing, path = tmp_path / "landing", str(tmp_path / "store")
    _land(landing, "a", _doc("A", (Y2020, 1)), 100)
    intake.take_in(spark, str(landing), path)
    _land(landing, "b", _doc("A", (Y2020, 2)), 200)

    def stop(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(Published, "commit", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            intake.take_in(spark, str(landing), path)
    assert _bars(spark, path) == [("A", "2020-01-01 00:00:00", 1.0)]
    assert intake.take_in(spark, str(landing), path).documents == 1
    assert _bars(spark, path) == [("A", "2020-01-01 00:00:00", 2.0)]


def test_of_two_runs_at_once_one_fails(spark, tmp_path, monkeypatch):
    landing, path = tmp_path / "landing", str(tmp_path / "store")
    _land(landing, "a", _doc("A", (Y2020, 1)), 100)
    now = Published.now

    def overtaken(self):
        found = now(self)
        self.commit({"other": {"runs": []}})
        return found

    monkeypatch.setattr(Published, "now", overtaken)
    with pytest.raises(RuntimeError, match="another run"):
        intake.take_in(spark, str(landing), path)


def test_several_documents_in_a_file_and_untouched_parts(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "store")
    _land(landing, "a", "\n".join([_doc("A", (Y2020, 1)), _doc("B", (Y2021, 2))]), 100)
    assert intake.take_in(spark, str(landing), path, one_per_line=True).documents == 2
    before = Published(path).parts()
    _land(landing, "b", _doc("A", (Y2021, 3)), 200)
    intake.take_in(spark, str(landing), path, one_per_line=True)
    after = Published(path).parts()
    assert after["2020"] == before["2020"] and after["2021"] != before["2021"]
    assert [close for _, _, close in _bars(spark, path)] == [1.0, 3.0, 2.0]


def test_rows_are_those_of_the_parser(spark):
    docs = spark.createDataFrame([(_doc("A", (Y2020, 1)), "x")], "value string, origin string")
    assert d.ohlc_bars(docs, ["origin"]).drop("origin").collect() == d.ohlc_bars(docs).collect()


def test_rows_move_once_in_slices_of_parts(spark, tmp_path, monkeypatch):
    landing, path = tmp_path / "landing", str(tmp_path / "store")
    weeks = [(Y2020 + i * WEEK, i) for i in range(40)]
    for at in (100, 200):
        _land(landing, f"d{at}", _doc("A", *((t, c + at) for t, c in weeks)), at)
    monkeypatch.setattr(intake, "SLICE_BYTES", 400)
    intake.take_in(spark, str(landing), path)
    assert _bars(spark, path) == _bars_of("A", weeks, 200)
    _land(landing, "d150", _doc("A", *((t, c + 150) for t, c in [*weeks, (Y2021, 0)])), 150)
    intake.take_in(spark, str(landing), path)
    assert _bars(spark, path) == _bars_of("A", weeks, 200) + [("A", "2021-01-01 00:00:00", 150.0)]
    rows = intake.BARS.parse(spark.createDataFrame([], "value string, _landed timestamp, _path string"), ["_landed", "_path"])
    plan = intake._newest(rows, intake.BARS, 2).sortWithinPartitions("_part", "asset", "ts")._jdf.queryExecution()
    assert plan.sparkPlan().toString().count("SortAggregate") == 2
    assert plan.optimizedPlan().toString().count("RepartitionByExpression") == 1


def _bars_of(asset, weeks, more):
    stamp = lambda t: str(datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None))
    return [(asset, stamp(t), float(c + more)) for t, c in weeks]
