"""Row numbers inside groups of any size.

A window puts a whole group into one task. Here rows are dealt to ranges of (group, order), so that a large group
spreads over several tasks; the number of a row is its place among all rows less the place of its group's first row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywick.session import materialize

# monotonically increasing ids hold the task in the bits above these
_LOCAL_BITS = 33


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: str = "number", count: str = "count"
) -> DataFrame:
    """``df`` with each row's ``number`` from 1 inside its group, and the group's ``count``.

    Rows move once, in their order; what tells the numbers is counted from the written rows: a row per range (as many
    as there are shuffle partitions, so a broadcast of them is bounded) and a row per group and range. Null keys form a
    group.
    Rows that ``order`` leaves equal are numbered as they happen to lie, once and for all.
    """
    by_key = [F.col(k).asc_nulls_first() for k in keys]
    ranged = df.repartitionByRange(*by_key, *order).sortWithinPartitions(*by_key, *order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")

    part = F.shiftright("_at", _LOCAL_BITS)
    # a row per range: the window has no key, but as many rows as there are ranges
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    rows = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_place", place)

    # a group goes over several ranges: a row per group and range says where the group's first row is, and no task
    # has to take in more rows of a group than one range of it
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    pieces = rows.groupBy(F.col("_part").alias("_piece"), *named).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*(f"_key{i}" for i in range(len(keys))))
    whole = pieces.withColumns({"_first": F.min("_first").over(group), count: F.sum("_rows").over(group)}).drop("_rows")
    # written, so that they are sent to all tasks only if they are few
    whole = materialize(whole, "groups")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return rows.join(whole, (F.col("_part") == F.col("_piece")) & same).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_place") - F.col("_first") + 1).alias(number), count
    )
