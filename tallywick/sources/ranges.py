"""Files read and written by byte ranges, in the folder and its files that a path names.

Paths are URIs or local paths that Arrow's file systems reach; tasks open them themselves, each its own range. Written
folders follow the readers' rule: names that begin with ``_`` or ``.`` are not data.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

# what Spark's file systems are called here
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def open_range(uri: str) -> pa.NativeFile:
    store, path = open_uri(uri)
    return store.open_input_file(path)


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``path, length`` of the data files below a path; only their names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").endswith(suffix)).select("path", "length")


class NewFile:
    """A file that gets its name when it is complete, so that readers see whole files only."""

    def __init__(self, folder: str, name: str):
        self.store, base = open_uri(folder)
        self.store.create_dir(base, recursive=True)
        self.final = f"{base.rstrip('/')}/{name}"
        self.hidden = f"{base.rstrip('/')}/_{uuid.uuid4().hex}-{name}"
        self.sink = self.store.open_output_stream(self.hidden)

    def write(self, data: bytes) -> None:
        self.sink.write(data)

    def close(self) -> None:
        self.sink.close()
        self.store.move(self.hidden, self.final)
