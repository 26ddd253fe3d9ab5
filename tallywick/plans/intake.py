"""Documents taken in as they land: each is parsed once, and what it says replaces what earlier ones said.

A store holds a log of the files that were taken in and the rows they gave, by part (a year of bars). A run lists the
landing folder, leaves out the files in the log, parses the others, and merges their rows by key with those of the parts
they touch; other parts are not read. Log and parts are published by one pointer (see :class:`Published`), so a run that
stops half-way has taken in nothing, and the next one begins where the last complete one ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywick.sources.documents import listings, ohlc_bars
from tallywick.sources.published import Published

_LOG = "log"
_FILE = "path string, length bigint, landed timestamp"
_NO_PART = "__HIVE_DEFAULT_PARTITION__"
#: Bytes of documents per slice of a part: even if all are of one part, a task takes in about as many.
SLICE_BYTES = 256 << 20
#: Columns that tell which document a row is from: the later one holds, of two at once the one of the greater name.
_FROM = ("_landed", "_path")


@dataclass(frozen=True)
class Kind:
    """A kind of document: how to parse it (keeping the columns it is told to), its rows' key, and the part they are in."""

    parse: Callable[[DataFrame, Sequence[str]], DataFrame]
    keys: tuple[str, ...]
    part: str


#: Price documents: a bar per asset and time, kept by year.
BARS = Kind(lambda docs, carried: ohlc_bars(docs, carried).withColumn("_part", F.year("ts")), ("asset", "ts"), "_part")
#: Listing pages: a coin per id, kept by thousands of ids.
COINS = Kind(
    lambda docs, carried: listings(docs, carried).withColumn("_part", F.floor(F.col("id") / 1000).cast("int")), ("id",), "_part"
)


@dataclass(frozen=True)
class Taken:
    """What a run did: documents parsed, and the parts it wrote."""

    documents: int
    parts: tuple[str, ...]


def _listed(spark: SparkSession, landing: str) -> DataFrame:
    """``path, length, landed`` of the files in a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing)
    return files.select("path", "length", F.col("modificationTime").alias("landed"))


def _log(spark: SparkSession, store: Published, parts: dict) -> DataFrame:
    found = spark.createDataFrame([], _FILE)
    for run in parts.get(_LOG, {"runs": []})["runs"]:
        found = found.unionByName(spark.read.schema(_FILE).parquet(f"{store.run_folder(run)}/{_LOG}"))
    return found


def _rows(spark: SparkSession, store: Published, parts: dict, schema) -> DataFrame:
    found = spark.createDataFrame([], schema)
    runs: dict[str, list[str]] = {}
    for part, entry in parts.items():
        if part != _LOG:
            for run in entry["runs"]:
                runs.setdefault(run, []).append(part)
    for run, held in runs.items():
        base = f"{store.run_folder(run)}/rows"
        rows = spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/_part={p}" for p in held))
        found = found.unionByName(rows)
    return found


def _newest(rows: DataFrame, kind: Kind, slices: int) -> DataFrame:
    """Of the rows of a key that from the latest document, in the tasks that write them: each a slice of a part's keys.

    Rows move once. A part's rows go to as many tasks as there are slices, which bounds both a task's rows and the
    files of a part.
    """
    by = (kind.part, *kind.keys, "_slice")
    others = [c for c in rows.columns if c not in by]
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*kind.keys), F.lit(slices)))
    latest = F.max_by(F.struct(*others), F.struct(*_FROM)).alias("_row")
    chosen = sliced.repartition(kind.part, "_slice").groupBy(*by).agg(latest)
    return chosen.select(kind.part, *kind.keys, *(F.col(f"_row.`{c}`") for c in others)).select(*rows.columns)


def take_in(spark: SparkSession, landing: str, path: str, kind: Kind = BARS, one_per_line: bool = False) -> Taken:
    """Takes in the documents that landed since the last run; a file that was written anew counts as another one.

    A file is a document, or with ``one_per_line`` each of its lines. Rows of equal keys are one, of the document that
    landed last. Of two runs at once, one fails and takes in nothing.
    """
    store = Published(path)
    version, parts = store.now()
    new = _listed(spark, landing).join(_log(spark, store, parts), ["path", "length", "landed"], "left_anti")
    run = store.new_run()
    folder = store.run_folder(run)
    new.coalesce(1).write.parquet(f"{folder}/{_LOG}")  # file names, as many as the driver lists anyway
    # what lands from here on is for the next run
    log = spark.read.schema(_FILE).parquet(f"{folder}/{_LOG}")
    names = [row["path"] for row in log.select("path").collect()]
    if not names:
        return Taken(0, ())
    place = F.col("_metadata")
    read = spark.read.text(names, wholetext=not one_per_line)
    docs = read.select("value", place["file_modification_time"].alias(_FROM[0]), place["file_path"].alias(_FROM[1]))
    # parsed twice, for its parts and for its rows, as that is less than to write the rows and move them again
    fresh = kind.parse(docs, _FROM)
    touched = {_NO_PART if r[0] is None else str(r[0]) for r in fresh.select(kind.part).distinct().collect()}
    before = _rows(spark, store, {p: e for p, e in parts.items() if p in touched}, fresh.schema)
    size = log.agg(F.sum("length")).first()[0]
    merged = _newest(before.unionByName(fresh), kind, 1 + size // SLICE_BYTES)
    merged.sortWithinPartitions(kind.part, *kind.keys).write.partitionBy(kind.part).parquet(f"{folder}/rows")
    documents = read.count() if one_per_line else len(names)
    runs = [*parts.get(_LOG, {"runs": []})["runs"], run]
    store.commit({_LOG: {"runs": runs}, **{p: {"runs": [run]} for p in touched}}, expected=version)
    return Taken(documents, tuple(sorted(touched)))


def taken_rows(spark: SparkSession, path: str, kind: Kind = BARS) -> DataFrame:
    """The rows of all documents taken in, a row per key."""
    empty = spark.createDataFrame([], "value string, _landed timestamp, _path string")
    schema = kind.parse(empty, _FROM).schema
    store = Published(path)
    return _rows(spark, store, store.parts(), schema).drop(*_FROM, kind.part)
