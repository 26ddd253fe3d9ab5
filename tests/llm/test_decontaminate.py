"""Benchmark overlaps against brute force."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallywick.llm import decontaminate as d

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_window_with_few_substitutions_holds_a_hit():
    for count in range(d.WINDOW - d.NEED + 1):
        for wrong in combinations(range(d.WINDOW), count):
            assert any(
                all(at + i not in wrong for i, used in enumerate(seed) if used == "1")
                for seed in d.SEEDS
                for at in range(d.WINDOW - len(seed) + 1)
            ), wrong


def _words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def _most(doc, item):
    best = 0
    for shift in range(-len(item), len(doc)):
        same = [0 <= shift + i < len(doc) and doc[shift + i] == w for i, w in enumerate(item)]
        best = max(best, max(sum(same[i : i + d.WINDOW]) for i in range(len(item))))
    return best


def _tables(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (9, 10, 12, 14, 20, 40, 60, 15, 5, 7, 4, 2, 1)]
    docs = [text(rng.randint(0, 120)) for _ in range(30)]
    for k in range(60):
        item = list(rng.choice(items))
        a = rng.randint(0, max(0, len(item) - 10))
        part = item[a : a + rng.randint(8, 40)]
        for i in rng.sample(range(len(part)), rng.randint(0, len(part) // 4)):
            part[i] = "substituted"
        docs.append(text(rng.randint(0, 30)) + part + text(rng.randint(0, 30)))
    docs += [items[8], ["x", *items[9], "y"], items[9][:-1], items[10], items[10] + ["more"], items[11], items[12]]
    return items, docs


@pytest.mark.parametrize("block", [d.BLOCK_WORDS, 10])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    monkeypatch.setattr(d, "BITS", 1 << 10)
    items, docs = _tables(spark)
    doc_rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(docs)]
    doc_rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "... !!", "en", "s", 0)]
    item_rows = [(i, " ".join(w).upper() + "!") for i, w in enumerate(items)] + [(90, None), (91, ""), (70, ", ".join(items[4]))]
    got = d.overlaps(spark.createDataFrame(doc_rows, DOCS), spark.createDataFrame(item_rows, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.agreeing for r in got.collect()}
    expected = {}
    for i, doc in enumerate(docs):
        for j, item in enumerate(items):
            if (most := _most(doc, item)) >= min(d.NEED, len(item)) and (len(item) >= d.SHORTEST or len(doc) == len(item)):
                expected[i, j] = most
    assert len(expected) > 20 and found == expected


def test_blocks_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WORDS", 300)
    monkeypatch.setattr(d, "PIECE", 64)
    monkeypatch.setattr(d, "OVERLAP", 24)
    words = [f"u{i}" for i in range(1000)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(a, " ".join(words[a : a + 14]), "en", "s", 0) for a in range(0, 980, 7)], DOCS)
    assert {r.doc_id for r in d.overlaps(docs, items).collect()} == set(range(0, 980, 7))


def test_keep_clean(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"before {passage} after"), (2, "a clean text of no account whatever it may say, at length"), (3, None), (None, passage), (None, "clean"), (1, "clean too")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumnRenamed("lang", "item_id")
    docs = docs.withColumn("content", F.lit(5)).withColumn("at", F.lit(1))
    got = d.keep_clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted((r.text or "" for r in got.collect())) == sorted(t or "" for i, t in rows if passage not in (t or ""))


def test_repetitive_texts_need_bounded_memory(spark):
    """Every word of the one meets every word of the other: 80 million hits, 24,000 ways to lie over each other."""
    docs = spark.createDataFrame([(1, "ab " * 20_000), (2, "ab cd " * 3_000), (3, "cd")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab " * 4_096), (2, "cd ab " * 6)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.agreeing for r in d.overlaps(docs, items).collect()}
    assert found == {(1, 1): 12, (2, 2): 12}


def test_place_is_where_the_item_begins(spark):
    words = [f"q{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, "x y z " + " ".join(words)), (2, " ".join(words[2:]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {(r.doc_id, r.place, r.agreeing) for r in d.overlaps(docs, items).collect()} == {(1, 3, 12), (2, 0, 10)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", "en", "s", 0)], DOCS)
    assert d.overlaps(docs, items).count() == d.overlaps(full, items).count() == 0
    assert d.keep_clean(full, items).count() == 1


def test_texts_are_not_moved(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", "en", "s", 0)], DOCS)
    plan = d.overlaps(docs, spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "BroadcastHashJoin" in text and "SortMergeJoin" not in text
