"""Shared files and column names for the operators of this subpackage.

Tasks write raw files through ``pyarrow.fs`` to the folder the cluster names in ``spark.checkpoint.dir``. A file
counts only once its row is in a manifest that Spark has committed, so files of lost or repeated tasks are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType

from tallywick.session import materialize, scratch_path

__all__ = ["attempt_file", "free_names", "materialize", "open_store", "output_folder", "own_columns", "with_arrays"]


def output_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, that executors share."""
    path = scratch_path(spark, name)
    return path if ":" in path.split("/")[0] else "file://" + os.path.abspath(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def attempt_file(folder: str, stem: str, suffix: str) -> str:
    """A file name no other attempt of a task uses."""
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def own_columns(df: DataFrame) -> list[str]:
    """The columns of ``df`` as references, whatever characters their names have."""
    return [f"`{name.replace('`', '``')}`" for name in df.columns]


def with_arrays(
    df: DataFrame, given: str, added: dict[str, DataType], make: Callable[[list], list[pa.Array]]
) -> DataFrame:
    """``df`` with the columns ``added``, which ``make`` computes from a batch of the column ``given``.

    Rows stay where they are. A name that ``df`` has already gets an underscore.
    """
    place = df.columns.index(given)
    names = free_names(df, *added)
    # by number, as a name may hold any character
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    schema = plain.select("*").schema
    for i, kind in enumerate(added.values()):
        schema = schema.add(f"n{i}", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = make(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*df.columns, *names)
