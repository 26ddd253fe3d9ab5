"""Row numbers over ranges against numbering in memory."""

import random
from itertools import groupby

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallywick.operators.numbering import numbered


def _expected(rows):
    found = []
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    for _, group in groupby(ordered, key=lambda r: r[0]):
        group = list(group)
        found += [(*row, i, len(group)) for i, row in enumerate(group, 1)]
    return sorted(found, key=str)


def _got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "k long, at long").repartition(parts)
    out = numbered(df, ["k"], [F.col("at").asc_nulls_first()], "number", "size")
    return sorted(map(tuple, out.collect()), key=str), out


def test_a_group_with_most_rows_spreads_over_tasks(spark):
    rows = [(7, i) for i in range(3_000)] + [(k, i) for k in range(50) if k != 7 for i in range(k % 5)] + [(None, 1), (None, None)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, out = _got(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _expected(rows)
    assert len(out.inputFiles()) > 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 10**9)), max_size=40, unique_by=lambda r: r[1]))
def test_any_rows(spark, rows):
    assert _got(spark, rows)[0] == _expected(rows)


def test_two_keys_and_descending(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 9), ("a", 2, 3), (None, 1, 4)], "x string, y int, at int")
    out = numbered(df, ["x", "y"], [F.col("at").desc()])
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 1, 5, 2, 2), ("a", 1, 9, 1, 2), ("a", 2, 3, 1, 1), (None, 1, 4, 1, 1)]


def test_no_task_takes_in_a_whole_group_at_the_end(spark):
    rows = spark.range(4_000).select(F.lit(1).alias("k"), "id")
    settings_of = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings_of.items():
        spark.conf.set(key, value)
    try:
        out = numbered(rows, ["k"], [F.col("id").desc()])
        per_task = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("number").alias("s")).collect()
    finally:
        for key in settings_of:
            spark.conf.unset(key)
    assert sum(r.n for r in per_task) == 4_000 and sum(r.s for r in per_task) == 4_000 * 4_001 // 2
    assert max(r.n for r in per_task) < 4_000
