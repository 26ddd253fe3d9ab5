"""Tables in and out: CSV, TSV and Parquet."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallywick import schemas
from tallywick.domains import TITLES
from tallywick.operators.report import printed_order
from tallywick.session import side_by_side
from tallywick.sources.published import Published
from tallywick.sources.quoted import read_quoted
from tallywick.sources.ranges import NewFile, open_range
from tallywick.sources.survey import read_survey


def read_cases(spark: SparkSession, path: str, multi_line: bool = False, problems: str | None = None) -> DataFrame:
    """Case list from CSV with a header line.

    Quotes inside quotes are doubled, empty fields and ``NA`` are missing, blanks around values are dropped. Values
    that are no numbers become null; ``problems`` names a further column that holds the line of such a row (and of one
    with too many or too few fields), else null. ``multi_line`` allows line breaks in quotes, at the cost of a
    second pass over the lines; files are still read in parallel (see :mod:`tallywick.sources.quoted`).
    """
    return _read_text_table(spark, path, schemas.CASES, ",", multi_line, problems, trim=True)


def read_codes(spark: SparkSession, path: str, multi_line: bool = False, problems: str | None = None) -> DataFrame:
    """County codes per case from the exported survey file (CSV with a header line), blanks kept."""
    return _read_text_table(spark, path, schemas.CODES, ",", multi_line, problems)


def read_survey_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case list from survey files, whose value labels are the labels of the exported list."""
    return read_survey(spark, path, schemas.CASES)


def read_survey_codes(spark: SparkSession, path: str) -> DataFrame:
    """County codes per case from survey files; blanks before and within a code are kept."""
    return read_survey(spark, path, schemas.CODES)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """State lookup from a tab-separated file with a header line; every column is text."""
    return _read_text_table(spark, path, schemas.STATES, "\t")


def read_counties(spark: SparkSession, path: str) -> DataFrame:
    """County boundaries; the geometry is passed through unread."""
    return spark.read.parquet(path).select("GEOID", "STATEFP", "geometry")


def _read_text_table(
    spark: SparkSession,
    path: str,
    schema: str,
    sep: str,
    multi_line: bool = False,
    problems: str | None = None,
    trim: bool = False,
) -> DataFrame:
    if multi_line:
        rows = read_quoted(
            spark, path, schema, sep, problems, nullValue="NA",
            ignoreLeadingWhiteSpace=str(trim).lower(), ignoreTrailingWhiteSpace=str(trim).lower(),
        )
    else:
        # columns are found by position in the schema, so a file with another header is an error, not a mix-up
        rows = spark.read.csv(
            path,
            schema=schema if problems is None else f"{schema}, {problems} string",
            sep=sep,
            header=True,
            enforceSchema=False,
            escape='"',
            nullValue="NA",
            ignoreLeadingWhiteSpace=trim,
            ignoreTrailingWhiteSpace=trim,
            columnNameOfCorruptRecord=problems,
        )
    texts = [name for name, kind in rows.dtypes if kind == "string" and name != problems]
    return rows.withColumns({name: F.nullif(F.col(name), F.lit("")) for name in texts})


def save_incidents(incidents: DataFrame, path: str) -> None:
    """Incident snapshot, one folder per year and sorted by state and county inside.

    A year filter then skips folders and a state filter skips row groups. ``rebalance`` splits a large year
    over several tasks and files and keeps small years in one.
    """
    incidents.hint("rebalance", "Year").sortWithinPartitions("Year", "State", "CNTYFIPS").write.partitionBy(
        "Year"
    ).parquet(path)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INCIDENTS).parquet(path)


def save_snapshot(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


_REPORT = "_report.json"
#: The part of a report that stands for all states without a part of their own.
_OTHER_STATES = "*"


def publish_report(
    tables: Mapping[str, DataFrame],
    path: str,
    format: str = "parquet",
    titles: bool = False,
    only_states: Sequence[str] | None = None,
) -> None:
    """Writes a run of all tables, split by state, in printed order, with the printed titles if wanted; then publishes it.

    Readers see the tables of before until every table is written, and those of now from then on: all of them, or with
    ``only_states`` these states', also of tables in which a state now has no rows.
    """
    store = Published(path)
    run = store.new_run()
    folder = store.run_folder(run)

    def write(name: str) -> str:
        table = tables[name] if format == "parquet" else _as_text(tables[name])
        ordered = table.repartition("State").sortWithinPartitions("State", *printed_order(name))
        rows = with_titles(ordered, name) if titles else ordered
        rows.write.format(format).option("header", True).partitionBy("State").save(f"{folder}/{name}")
        return rows.schema.json()

    schemas_of = side_by_side({name: partial(write, name) for name in tables})
    about = NewFile(folder, _REPORT)
    about.write(json.dumps({"format": format, "schemas": schemas_of}).encode())
    about.close()
    entry = {"runs": [run], "note": None}
    store.commit({state: entry for state in only_states or [_OTHER_STATES]}, replace=only_states is None)


def read_report_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the published report; each state from the run that last wrote it."""
    store = Published(path)
    runs: dict[str, list[str]] = {}
    for state, entry in store.parts().items():
        runs.setdefault(entry["runs"][0], []).append(state)
    if not runs:
        raise ValueError(f"no report is published in {path}")
    named = [state for states in runs.values() for state in states if state != _OTHER_STATES]
    found = []
    for run, states in sorted(runs.items(), key=lambda r: _OTHER_STATES not in r[1]):
        folder = store.run_folder(run)
        with open_range(f"{folder}/{_REPORT}") as source:
            about = json.loads(source.read().decode())
        schema = StructType.fromJson(json.loads(about["schemas"][name]))
        rows = spark.read.format(about["format"]).schema(schema).option("header", True).load(f"{folder}/{name}")
        mine = F.col("State").isin(*states)
        found.append(rows.where(mine | ~F.col("State").isin(*named) if _OTHER_STATES in states else mine))
    # a county table has a column for each year of its run
    return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), found)


def _as_text(df: DataFrame) -> DataFrame:
    """Binary columns in base64, for formats that hold text only."""
    binary = [name for name, kind in df.dtypes if kind == "binary"]
    return df.withColumns({name: F.base64(name) for name in binary}) if binary else df


def with_titles(df: DataFrame, table: str) -> DataFrame:
    """Columns renamed to the titles of the printed table; a year column ``y2017`` reads ``2017``."""
    years = {name: name[1:] for name in df.columns if re.fullmatch(r"y\d+", name)}
    return df.withColumnsRenamed(TITLES.get(table, {}) | years)


def printed_average_table(table: DataFrame, asset_tick: str) -> DataFrame:
    """One asset's averages as printed: only the columns of its tier, the overall one named after its weeks.

    One job finds the asset's rows, a row for each listing of its ticker, and with them these names; without one, as
    for an asset without a tier, the result is empty.
    """
    one = table.filter(F.col("asset_tick") == asset_tick)
    rows = one.collect()
    first = rows[0] if rows else None
    shown = [name for name in ("avg_50", "avg_100") if first is not None and first[name] is not None]
    overall = "avg_overall" if first is None else first["overall_title"]
    wanted = ["asset", "current_price", *shown, "avg_overall"]
    schema = StructType([one.schema[name] for name in wanted])
    found = table.sparkSession.createDataFrame([tuple(row[name] for name in wanted) for row in rows], schema)
    return with_titles(found.withColumnRenamed("avg_overall", overall), "average_table")
