"""Cross-parsing against plain matching, and held-out accuracy."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallywick.llm import language

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TRAIN = [("xx", "abab cab bac abba cab dab bad"), ("yy", "xyz zyx yxxy zzy xyx zyz yy"), ("zz", "abc xyz cba zyx")]


def _phrases(codes, sample):
    """Greedy longest matches, by searching the sample itself; blocks end phrases."""
    text, known = "".join(map(chr, codes)), "".join(map(chr, sample))
    count = 0
    for start in range(0, len(text), language.BLOCK):
        block, at = text[start : start + language.BLOCK], 0
        while at < len(block):
            end = at + 1
            while end < len(block) and block[at : end + 1] in known:
                end += 1
            count, at = count + 1, end
    return count


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcdxyz ABé1.", max_size=60), max_size=5))
def test_phrase_counts(texts):
    model = language.learn(TRAIN)
    counts, _ = language.phrases(texts, model)
    for text, row in zip(texts, counts):
        codes, _ = language._codes(text, model.symbols)
        for (_, sample), n in zip(TRAIN, row):
            assert n == _phrases(codes, language._codes(sample, model.symbols)[0])


def test_long_texts_are_walked_in_parts(monkeypatch):
    model, rng = language.learn(TRAIN), random.Random(1)
    texts = ["".join(rng.choice("abcxyz ") for _ in range(n)) for n in (0, 1, 9_000, 30, 2_048, 4_097)]
    whole, _ = language.phrases(texts, model)
    monkeypatch.setattr(language, "_BATCH", 3_000)
    parts, _ = language.phrases(texts, model)
    assert (whole == parts).all()
    for text, row in zip(texts, whole):
        codes, _ = language._codes(text, model.symbols)
        assert row[0] == _phrases(codes, language._codes(TRAIN[0][1], model.symbols)[0])


def test_predictions():
    model = language.learn(TRAIN)
    names, scores = language.predict([None, "", "12 -- !", "abab cab", "ZYX xyx", "中文"], model)
    assert names[:5] == ["und", "und", "und", "xx", "yy"] and names[5] in ("xx", "yy", "zz")
    assert ((scores >= 0) & (scores <= 1)).all() and not scores[:3].any()
    assert math.isclose(scores[5], 0, abs_tol=0.5)


def test_nothing_learned():
    names, scores = language.predict(["any"], language.learn([]))
    assert names == ["und"] and not scores.any()
    names, scores = language.predict(["any"], language.learn([("en", "any text")]))
    assert names == ["en"] and scores[0] == 1


def test_rows_and_columns_stay(spark):
    rows = [(1, "abab", "xx", "s", 0), (1, "abab", "xx", "s", 0), (None, None, None, None, None), (2, "9", "yy", "s", 0), (3, "zyx " * 50_000, "yy", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit(-1))
    got = language.identify(docs, language.learn(TRAIN))
    assert got.columns == [*docs.columns, "lang_pred_", "score_"]
    found = got.collect()
    names = sorted(r.lang_pred_ for r in found)
    assert names[:4] == ["und", "und", "xx", "xx"] and names[4] in ("yy", "zz")
    assert {r.lang_pred for r in found} == {"mine"}
    assert language.identify(docs.limit(0), language.learn(TRAIN)).count() == 0


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(documents):
    found = language.identify(documents, language.learned_from(documents))
    right = found.where(language.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98


def test_labels_of_held_out_documents_are_not_read(documents):
    wrong = documents.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "wrong").otherwise(F.col("lang")))
    model = language.learned_from(wrong)
    assert "wrong" not in model.languages
    assert np.array_equal(model.table, language.learned_from(documents).table)


def test_copies_take_one_place_of_the_sample(spark):
    texts = [f"text {i}" for i in range(60)]
    rows = [(i, text, "xx", "s", 0) for i, text in enumerate(texts)] + [(100 + i, text, "xx", "s", 0) for i in range(60) for text in texts[:5]]
    got = language.sample(spark.createDataFrame(rows, DOCS))
    assert len(got) == len(set(got)) == language.SAMPLE_TEXTS
    # a group of copies at the very front
    first = language.sample(spark.createDataFrame(rows, DOCS), order=F.when(F.col("text") == "text 3", -1).otherwise(F.xxhash64("text")))
    assert ("xx", "text 3") in first and len(first) == language.SAMPLE_TEXTS


def test_keep_identified(spark, documents):
    extra = spark.createDataFrame([(10**6, "12 34", "en", "s", 5), (10**6 + 1, None, "en", "s", 0)], DOCS)
    got = language.keep_identified(documents.unionByName(extra))
    assert got.columns == documents.columns and got.count() == documents.count()
    assert language.keep_identified(documents.limit(0)).count() == 0


def test_texts_stay_if_nothing_was_learned(spark):
    rows = [(i, f"plain english words number {i}", None, "s", 0) for i in range(20)] + [(90, None, None, "s", 0), (91, "12 34", None, "s", 0)]
    got = language.keep_identified(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in got.collect()) == list(range(20))


def test_sampled_pieces_come_from_anywhere(spark):
    long = "".join(f"{i:07d}" for i in range(20_000))
    rows = [(i, long[i * 1_000 :], "xx", "s", 0) for i in range(40)]
    pieces = [piece for _, piece in language.sample(spark.createDataFrame(rows, DOCS))]
    assert all(len(p) == language.SAMPLE_PIECE and p in long for p in pieces)
    starts = [p not in {r[1][: language.SAMPLE_PIECE] for r in rows} for p in pieces]
    assert sum(starts) > 30
