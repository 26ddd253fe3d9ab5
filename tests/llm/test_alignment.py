"""Alignment of two tokenizers against a plain walk over their tokens."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallywick.llm import alignment
from tallywick.llm.bpe import byte_symbols

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


class Plain:
    """The contract, token by token, with the libraries' encodings of whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocabulary = json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"]
        self.a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items()}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        if len(piece) == 6 and piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def document(self, text):
        """Groups, and the linked id pairs."""
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_strings, b_strings = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(a_strings) == b"".join(b_strings) == (" " + text).encode():
            return [], []
        groups, links, i, j, a_end, b_end, group = [], [], 0, 0, len(a_strings[0]), len(b_strings[0]), ([a[0]], [b[0]])
        while True:
            links.append((a[i], b[j]))
            if a_end == b_end:
                groups.append(group)
                i, j = i + 1, j + 1
                if i == len(a):
                    return groups, links
                group = ([a[i]], [b[j]])
                a_end, b_end = a_end + len(a_strings[i]), b_end + len(b_strings[j])
            elif a_end < b_end:
                i += 1
                a_end += len(a_strings[i])
                group[0].append(a[i])
            else:
                j += 1
                b_end += len(b_strings[j])
                group[1].append(b[j])

    def rows(self, rows):
        found = [(i, *self.document(t)) for i, t in rows]
        counts = Counter(pair for _, _, links in found for pair in set(links))
        best = {}
        for (a, _), n in counts.items():
            best[a] = max(n, best.get(a, 0))
        out = []
        for i, groups, links in found:
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            out.append(
                (
                    i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else "",
                )
            )
        return sorted(out, key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "  lead", "trail  ", "line\nbreak \n\n two\r\n", "tab\tand more",
    "<|endoftext|> <s> </s> <unk> <0x41>", "under▁score ▁ here", "▁", "x▁ y", "né à ünïcödé 日本語 テスト 🙂🙂 ​",
    "don't we'll I'm", "12345 67 8.9", "a\x00b", "\x1cq \x1d", "é combining", "The the THE", "word " * 50, "� ퟿",
]


def _sorted(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


def test_odd_texts_and_repeated_rows(spark, plain):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (3, "a"), (None, "a b"), (4, "y" * 3_000), (5, "ab " * 3_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs = docs.withColumn("block", F.lit("b")).withColumn("pairs", F.lit(1)).withColumn("a", F.lit(2))
    assert _sorted(alignment.alignments(docs, *PATHS)) == plain.rows(rows)


def test_empty_table_and_no_tokens_at_all(spark):
    assert alignment.alignments(spark.createDataFrame([], DOCS), *PATHS).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], DOCS)
    assert _sorted(alignment.alignments(none, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_whole_query(spark, plain):
    from tallywick.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _sorted(QUERIES["op13_token_alignment"](spark, sf)) == plain.rows(rows)


def test_blocks_of_any_size_give_the_same(plain):
    draw = random.Random(5)
    texts = ["".join(draw.choice(["ab", " ", "  ", "the", "é", "\n", "1", "."]) for _ in range(draw.randint(0, 60))) for _ in range(40)]
    pair = alignment._pair(*PATHS)
    whole = alignment.align(texts, pair)
    for i, text in enumerate(texts):
        counts, groups, parents, links = alignment.align([text], pair)
        assert {k: v[0] for k, v in counts.items()} == {k: v[i] for k, v in whole[0].items()}
        assert sorted(links) == sorted(whole[3][whole[2] == i])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    plain = PLAIN[0] if PLAIN else PLAIN.append(Plain()) or PLAIN[0]
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    counts, groups, _, links = alignment.align([text], alignment._pair(*PATHS))
    want, pairs = plain.document(text)
    assert next(iter(groups), b"").decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
    assert Counter(links.tolist()) == Counter((a << 32) | b for a, b in pairs)
    assert counts["n_links"][0] == len(pairs) and counts["n_groups"][0] == len(want)


PLAIN: list = []
