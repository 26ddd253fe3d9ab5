"""Exact duplicates against grouping in memory."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallywick.llm import exact_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[_normal(text)].append(doc_id)
    found = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept_yet = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and not kept_yet
            kept_yet |= kept
            found.append((i, keep, len(ids), kept))
    return sorted(found, key=str)


ROWS = [
    (1, "Same text"), (2, "same TEXT"), (3, "other"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300_000),
    (9, "X" * 300_000), (10, "same text "), (11, "SAME TEXT"), (11, "same text"), (None, "other"), (None, None), (12, "ſK"), (13, "ſk"),
]


@pytest.mark.parametrize("salts", [1, 7])
def test_groups(spark, salts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ROWS], DOCS).repartition(3)
    got = exact_dedup.duplicate_groups(docs, salts=salts).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == _expected(ROWS)


def test_digest_collisions_join_nothing(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ROWS], DOCS)
    got = exact_dedup.duplicate_groups(docs, digest=lambda c: F.lit(1)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == _expected(ROWS)


def test_keep_one_has_a_row_per_text_and_its_columns(spark):
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(ROWS)], DOCS)
    docs = docs.withColumn("keep_id", F.lit("mine")).withColumn("sha", F.lit(1))
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(_normal(r.text) for r in rows) == sorted({_normal(t) for _, t in ROWS})
    assert {r.doc_id for r in rows} == {3, 5, 6, 7, 9, 10, 11, 13}


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.duplicate_groups(docs).count() == 0
    assert exact_dedup.keep_one(docs).count() == 0


def test_plan_has_no_python_and_merges_before_moving(spark):
    plan = exact_dedup.duplicate_groups(spark.createDataFrame([], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("HashAggregate") == 6  # a partial one before each of three exchanges
