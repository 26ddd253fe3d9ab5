"""Exact quantiles of columns of any size, by selection.

Equal values are counted first, so a value that holds a third of all rows is one row per task. The different values are
dealt to ranges in their order; sums over the ranges tell where each range's ranks begin, and so which few ranges hold
the ranks that are asked for. Only these are read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallywick.session import materialize


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """``prob, value`` for each of ``probs``: linear interpolation between the two nearest ranks.

    Nulls are left out; without any value the result has a null for each. Between an infinite and a finite value the
    result is the nearer one's if the rank is whole, else as the arithmetic of doubles has it.
    """
    counted = df.select(F.col(f"`{column}`").cast("double").alias("value")).where(F.col("value").isNotNull())
    # zeros of either sign are one value
    cells = counted.select((F.col("value") + 0.0).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(
        cells.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), "values"
    )
    # a row per range
    sizes = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = sizes.select(
        "part", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(every).alias("total")
    )
    # of each quantile the two ranks, counted from 0, in the range that holds them
    wanted = [
        F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"), rank.cast("long").alias("rank"))
        for p in sorted(set(probs))
        for side, rank in (("low", F.floor(p * (F.col("total") - 1))), ("high", F.ceil(p * (F.col("total") - 1))))
    ]
    asked = ranges.select("part", "start", "rows", "total", F.inline(F.array(*wanted)))
    asked = asked.where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("rows")))
    # two rows for each quantile
    chosen = F.broadcast(asked.groupBy("part", "start", "total").agg(F.collect_list(F.struct("prob", "side", "rank")).alias("ranks")))
    upto = Window.partitionBy("part").orderBy("value")
    reached = placed.join(chosen, "part").withColumn("end", F.col("start") + F.sum("n").over(upto))
    here = F.filter("ranks", lambda r: (r["rank"] < F.col("end")) & (r["rank"] >= F.col("end") - F.col("n")))
    found = reached.select("value", "total", F.inline(here))
    share = F.col("prob") * (F.col("total") - 1) - F.floor(F.col("prob") * (F.col("total") - 1))
    pairs = found.groupBy("prob").agg(
        F.max(F.when(F.col("side") == "low", F.col("value"))).alias("low"),
        F.max(F.when(F.col("side") == "high", F.col("value"))).alias("high"),
        F.max(share).alias("share"),
    )
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    asked_for = df.sparkSession.createDataFrame([(float(p),) for p in sorted(set(probs))], "prob double")
    return asked_for.join(pairs.select("prob", value.alias("value")), "prob", "left")
