"""CSV with line breaks in quotes, read in parallel within a file.

Whether a line break ends a record depends on the quotes before it: it does after an even number. Lines are read where
Spark's scan splits the file; a first pass counts quotes per byte range, and for both cases (an even or an odd number
before the range) how many records begin in it. Sums over the ranges of a file then tell every range how it begins. In a
second pass each task joins the lines of its records; only the pieces of records that cross a border move.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_RANGES = "path string, start long, odd int, even_begins long, odd_begins long, returns boolean"
_RECORDS = "path string, number long, start long, whole boolean, text string"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of a batch that lie in one range."""
    if not batch.num_rows:
        return
    changed = np.zeros(batch.num_rows, bool)
    changed[0] = True
    for column in batch.columns[:2]:
        differ = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
        changed[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    cuts = [*np.flatnonzero(changed).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), batch.slice(a, b - a)


def _odd_before(lines: pa.Array, odd: int) -> tuple[np.ndarray, int]:
    """For each line, whether an odd number of quotes stands before it; and behind the last."""
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    behind = (np.cumsum(quotes) + odd) % 2
    return np.concatenate([[odd], behind[:-1]]), int(behind[-1])


def _ranges(lines: DataFrame) -> DataFrame:
    """Per byte range: whether its number of quotes is odd, and how many lines begin a record in either case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # path, start, odd, lines that begin at an even number, at an odd one, a carriage return in the first
        for batch in batches:
            for path, start, part in _runs(batch):
                if held is None or held[:2] != [path, start]:
                    if held:
                        yield _row(held)
                    held = [path, start, 0, 0, 0, (part.column(2)[0].as_py() or "").endswith("\r")]
                before, held[2] = _odd_before(part.column(2), held[2])
                odd = int(before.sum())
                held[3] += len(before) - odd
                held[4] += odd
        if held:
            yield _row(held)

    def _row(held: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(held, kinds)], names=_names(_RANGES))

    return lines.mapInArrow(run, _RANGES)


def _begun(ranges: DataFrame) -> DataFrame:
    """How each range begins: after an odd number of quotes or not, and after how many records; and its file's line ends."""
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    known = ranges.withColumn("begins_odd", odd.cast("int"))
    # with an odd number before the range, lines that see an odd number within it begin records
    begins = F.when(F.col("begins_odd") == 0, F.col("even_begins")).otherwise(F.col("odd_begins"))
    records = F.coalesce(F.sum(begins).over(earlier), F.lit(0))
    first = F.first("returns").over(Window.partitionBy("path").orderBy("start"))
    return known.select("path", "start", "begins_odd", records.alias("records"), first.alias("returns"))


def quoted_records(spark: SparkSession, path: str, header: Sequence[str] | None = None) -> DataFrame:
    """The records of all files below ``path`` as ``text``, with their line breaks; empty lines are none.

    With ``header``, the first record of every file must name these columns, and is left out. Quotes stand around whole
    values and are doubled inside; a single one within an unquoted value would be taken for a beginning. Lines end with
    a line feed; if a file's first line has a carriage return before it, so have all others, and none keeps it, in quotes
    either. If the last quote of a file is never closed, its record goes on to the
    end of the file.
    """
    place = F.col("_metadata")
    lines = spark.read.text(path, lineSep="\n").select(
        place["file_path"].alias("path"), place["file_block_start"].alias("start"), F.col("value")
    )
    # a row per byte range of the scan, some hundred bytes for its megabytes
    begun = F.broadcast(_begun(_ranges(lines)))
    columns = list(header) if header is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for path, start, part in _runs(batch):
                if held is None or (held.path, held.start) != (path, start):
                    if held:
                        yield from held.close()
                    held = _Range(path, start, *(part.column(i)[0].as_py() for i in (3, 4, 5)), columns)
                yield from held.add(part.column(2))
        if held:
            yield from held.close()

    placed = lines.join(begun, ["path", "start"]).select("path", "start", "value", "begins_odd", "records", "returns")
    found = placed.mapInArrow(run, _RECORDS)
    pieces = found.where(~F.col("whole")).groupBy("path", "number")
    # a piece per range that the record touches
    joined = pieces.agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("pieces"))
    crossing = joined.select("path", "number", F.array_join(F.col("pieces.text"), "\n").alias("text"))
    if columns is not None:
        # only a header that crosses a border is seen here
        crossing = crossing.where(~_is_header(F.col("text"), F.col("number"), columns))
    text = F.regexp_replace("text", "\r$", "").alias("text")
    return found.where("whole").select("text").unionByName(crossing.select(text)).where(F.col("text") != "")


def _is_header(text: Column, number: Column, columns: list[str]) -> Column:
    """Whether a record is its file's header; a first record with other names is an error."""
    names = F.regexp_replace(text, '[\r"\ufeff ]', "")
    wrong = F.raise_error(F.concat(F.lit("a header names other columns: "), text))
    return (number == 0) & F.coalesce(F.when(names == ",".join(columns), True), wrong.cast("boolean"))


class _Range:
    """Lines of one byte range, joined to records as they come."""

    def __init__(self, path: str, start: int, odd: int, records: int, returns: bool, header: list[str] | None):
        self.path, self.start, self.odd, self.returns, self.header = path, start, odd, returns, header
        self.number = records - 1
        self.whole = False  # lines before the first beginning belong to the range before
        self.open: list[str] = []

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        """Takes lines; gives the records that end before the last beginning among them."""
        before, self.odd = _odd_before(lines, self.odd)
        if self.returns:
            lines = pc.replace_substring_regex(lines, "\r$", "")
        begins = np.flatnonzero(before == 0)
        if not len(begins):
            self.open += lines.to_pylist()
            return
        self.open += lines.slice(0, begins[0]).to_pylist()
        yield from self._flush()
        # records of one line, which most are, need no joining
        ends = np.append(begins[1:], len(lines))
        single = ends - begins == 1
        single[-1] = False
        first = self.number + 1
        self.number += len(begins)
        skip = 1 if first == 0 and len(begins) > 1 and self._header(lines, begins[0], ends[0]) else 0
        some = begins[skip:][single[skip:]]
        if len(some):
            texts = pc.utf8_rtrim(lines.take(pa.array(some)), "\r")
            yield self._batch(texts, len(texts), True, 0)
        several = [
            "\n".join(lines.slice(a, b - a).to_pylist()) for a, b in zip(begins[skip:-1].tolist(), ends[skip:-1].tolist()) if b - a > 1
        ]
        if several:
            yield self._batch(pa.array([t.removesuffix("\r") for t in several], pa.string()), len(several), True, 0)
        self.open, self.whole = lines.slice(begins[-1]).to_pylist(), True

    def _header(self, lines: pa.Array, a: int, b: int) -> bool:
        return self._named("\n".join(lines.slice(a, b - a).to_pylist()))

    def _named(self, text: str) -> bool:
        """Whether a first record is a header; one with other names is an error."""
        if self.header is None:
            return False
        names = [n.strip() for n in next(csv.reader([text.removesuffix("\r").removeprefix("﻿")]), [])]
        if names != self.header:
            raise ValueError(f"the header of {self.path} names {names}, not {self.header}")
        return True

    def _flush(self) -> Iterator[pa.RecordBatch]:
        """The record that is open: whole if it began here and the next line begins another, else a piece."""
        if not self.open:
            return
        text = "\n".join(self.open)
        self.open = []
        if self.whole:
            if self.number == 0 and self._named(text):
                return
            yield self._batch(pa.array([text.removesuffix("\r")], pa.string()), 1, True, 0)
        else:
            yield self._batch(pa.array([text], pa.string()), 1, False, self.number)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The last record, a piece if its quotes are open."""
        if self.odd:
            self.whole = False
        yield from self._flush()

    def _batch(self, texts: pa.Array, rows: int, whole: bool, number: int) -> pa.RecordBatch:
        columns = [
            pa.array([self.path] * rows if not whole else [None] * rows, pa.string()), pa.array([number] * rows, pa.int64()),
            pa.array([self.start] * rows, pa.int64()), pa.array([whole] * rows), texts.cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_names(_RECORDS))


def read_quoted(spark: SparkSession, path: str, schema: str, sep: str = ",", problems: str | None = None, **options: str) -> DataFrame:
    """A table from CSV with a header line and line breaks in quotes; columns and ``options`` as Spark's reader has them.

    ``problems`` names a further column with the text of records that do not fit, else null.
    """
    names = _names(schema)
    full = schema if problems is None else f"{schema}, {problems} string"
    given = {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", **options}
    if problems is not None:
        given["columnNameOfCorruptRecord"] = problems
    records = quoted_records(spark, path, names)
    return records.select(F.from_csv("text", full, given).alias("row")).select("row.*")
