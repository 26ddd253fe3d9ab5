"""Held-out quality, defined results for odd texts, and where the labels come from."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywick.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def _made(n, seed):
    """Texts of invented words; toxic ones have a few words of their own."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tos", "vu", "sha", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["blasted", "wretched", "horrid"]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(40, 200))]
        label = int(rng.random() < 0.3)
        if label:
            for at in rng.sample(range(len(words)), len(words) // 20):
                words[at] = rng.choice(bad)
        rows.append((" ".join(words), label))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.learn(_made(400, 1))


def test_separates_held_out_texts(model):
    rows = _made(200, 2)
    scores = np.array([toxicity.score(t, model) for t, _ in rows])
    labels = np.array([x for _, x in rows])
    assert ((scores >= 0.5) == labels).mean() >= 0.95
    assert (scores[labels == 1][:, None] > scores[labels == 0]).mean() >= 0.97


def test_odd_texts(model, monkeypatch):
    for text in (None, "", " \n", "x", "é" * 100_000):
        assert 0 <= toxicity.score(text, model) < 0.5
    long = "ka lo mi wretched " * 5_000
    whole = toxicity.features(long, model.ordinary, model.toxic)
    monkeypatch.setattr(toxicity, "_BLOCK", 16)
    assert np.allclose(whole, toxicity.features(long, model.ordinary, model.toxic))


def test_without_both_labels_everything_scores_low():
    assert toxicity.score("any", toxicity.learn([])) < 0.01
    assert toxicity.score("any", toxicity.learn([("a b", 0)] * 20)) < 0.01


def test_table(spark, model):
    rows = [(1, "ka lo", "en", "s", 0), (1, "ka lo", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine"))
    got = toxicity.with_scores(docs, model)
    assert got.columns == [*docs.columns, "score_"] and got.count() == 3
    assert toxicity.with_scores(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark):
    rows = [(i, t, "en", "s", 0) for i, (t, _) in enumerate(_made(100, 3))]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, x) for i, (_, x) in enumerate(_made(100, 3))] + [(5, 1, None), (None, 1, 1)], LABELS)
    out = toxicity.held_out(F.col("doc_id"))
    changed = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learned_from(docs, labels) == toxicity.learned_from(docs, changed)
    assert toxicity.learned_from(docs.limit(0), labels).offset == -30.0


def test_learns_from_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 300)
    calm = [t for t, x in _made(900, 4) if not x]
    rows = [(t + " " + t, 0) if i % 2 else (t + " " + " ".join(f"{w} horrid wretched" for w in t.split()[:20]), 1) for i, t in enumerate(calm)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, (t, _) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, 1, x) for i, (_, x) in enumerate(rows)], LABELS)
    # the toxic words lie behind the characters that a prefix would have
    late = [(t, x) for t, x in rows if not x or "horrid" not in t[:300]]
    model = toxicity.learned_from(docs, labels)
    right = [(toxicity.score(t, model) >= 0.5) == x for t, x in late]
    assert sum(x for _, x in late) > 100 and np.mean(right) >= 0.95
    # the last figure tells the number of windows, and is of the whole texts
    whole = np.mean([np.log1p(-(-len(t.split()) // toxicity.WINDOW)) for t, _ in rows])
    assert abs(model.center[-1] - whole) < 0.1


def test_held_out_quality_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learned_from(docs, labels)
    kept = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")) & (F.col("lang") == "en"))
    found = toxicity.with_scores(kept, model).select("toxic", "score").toPandas()
    toxic, clean = found[found.toxic == 1].score.values, found[found.toxic == 0].score.values
    assert (toxic[:, None] > clean).mean() >= 0.9
    assert (clean < 0.5).mean() >= 0.95 and (toxic >= 0.5).mean() >= 0.75
