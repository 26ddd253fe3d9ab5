"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # the call site of every column expression helps while developing and slows down long queries' building
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_MB = 1024**2
# per shuffle partition, before the adaptive merge of small ones
_SHUFFLE_TARGET = 512 * _MB
# per scan task
_SCAN_TARGET = 256 * _MB


def scale_settings(input_bytes: int) -> dict[str, str]:
    """Partition settings for inputs of this size.

    Shuffles start with one partition per 512 MB, which adaptive execution merges where less data arrives;
    it never splits an evenly large one, so too few would be the costlier mistake. The same rule holds at every
    size: 100 TB mean some 200,000 partitions, and twice as many scan tasks of 256 MB.
    """
    partitions = max(200, -(-input_bytes // _SHUFFLE_TARGET))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(_SCAN_TARGET),
    }


def build_session(
    app: str = "tallywick", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the library's defaults, sized for its input; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = {} if input_bytes is None else scale_settings(input_bytes)
    given = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**DEFAULTS, **sized, **given}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Gives this library to the session's Python workers, on whatever machine they are; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallywick-code-")
    # Spark's own file server hands it on, so the folder need not be shared
    name = os.path.join(folder, "tallywick")
    context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder all executors share.

    A session without that setting uses a folder below its warehouse, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/tallywick-{uuid.uuid4().hex}/{name}"


def side_by_side(jobs: Mapping[str, Callable[[], T]], at_once: int = 8) -> dict[str, T]:
    """Runs several Spark jobs at once; each is too small to fill the cluster alone."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(jobs, pool.map(lambda job: job(), jobs.values())))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, sizes become known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_all(dfs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """:func:`materialize` for several tables at once."""
    return side_by_side({name: partial(materialize, df, name) for name, df in dfs.items()})
