"""The pipeline against its stages in memory, and the queries against their SQL."""

from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import check
import corpus_pipeline
from tallywick.llm import decontaminate, language, queries, simhash
from tallywick.llm.storage import materialize
from test_decontaminate import _most, _words
from test_exact_dedup import _normal

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    assert len(queries.QUERIES) == 13 and {*queries.QUERIES, "pipeline"} <= set(entry.queries())


def test_against_memory(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    items = [_words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    model = language.learned_from(spark.read.parquet(f"{SF}/documents.parquet"))
    names, _ = language.predict([t for _, t in rows], model)
    kept = {d: t for (d, t), name in zip(rows, names) if name != "und"}
    last = {}
    for d, t in kept.items():
        last[_normal(t)] = max(d, last.get(_normal(t), d))
    kept = {d: kept[d] for d in last.values()}
    prints = {d: simhash.fingerprint(t) for d, t in kept.items()}
    root = {d: d for d in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            for b in kept:
                if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    kept = {d: t for d, t in kept.items() if root[d] == d}
    clean = {
        d for d, t in kept.items()
        if not any(len(i) >= decontaminate.NEED and _most(_words(t), i) >= decontaminate.NEED for i in items if set(i) & set(_words(t)))
    }
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: len(library.encode(kept[d], add_special_tokens=False).ids) for d in clean}
    assert 100 < len(got) < len(rows)


def test_stages_return_the_documents_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert check.compare(spark, connection, SF, name).startswith("ok")


def test_stages_bear_odd_rows_and_columns(spark):
    """Nulls, empty, long and repeated texts, and columns named like those the operators use."""
    passage = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    texts = [None, "", " ", "12 34", "a few words", "A few words", "a few words", "long " * 30_000, passage, "é" * 9, passage + " more"]
    rows = [(None if i == 9 else min(i, 5) if i in (5, 6) else i, t, None if i % 3 else "en", None, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[7], (None, "a few words", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ["score", "fingerprint", "component_id", "sha", "content", "gone_id", "key0", "at", "item_id", "digest", "place", "a.b"]
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 20")).select(
        "*", *(F.lit(n).alias(name) for n, name in enumerate(clashes))
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns[5:] == clashes
        assert docs.where("score <> 0 OR item_id <> 8").count() == 0
    kept = [r.text for r in docs.where("doc_id < 12 OR doc_id IS NULL").collect()]
    assert sorted(t[:12] for t in kept) == sorted(["a few words", "long long lo", "é" * 9])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_links_survive_numpy_integers():
    assert simhash.fingerprint("a b c d e") == int(np.uint64(simhash.fingerprint("A B C D E")))


def test_every_query_reads_all_documents(spark):
    counts = defaultdict(int)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_language_id", "op3_bpe", "op5_simhash_dedup", "op9_toxicity", "op10_exact_dedup"):
        counts[name] = entry.queries()[name](spark, SF).count()
    assert set(counts.values()) == {n}
