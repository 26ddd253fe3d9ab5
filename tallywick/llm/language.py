"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a sample of labelled text answers how far a text can be matched. A text is
cut greedily into the longest phrases that occur in the sample; ``phrases * log2(sample) / letters`` estimates its
cross entropy, and the language with the least wins.

Greedy cutting never looks back, so automaton and cutting together are one table of transitions, each with a mark
where a phrase starts. Tasks walk all texts of a batch in step with numpy. Texts are cut into blocks first (a phrase
ends at a block's end, for all languages alike), so memory depends on the batch and not on a text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType

from tallywick.llm.storage import own_columns, with_arrays

UNDETERMINED = "und"
#: Bounds of the training sample: texts per language, characters of each, characters of a language in all.
SAMPLE_TEXTS = 48
SAMPLE_PIECE = 2_000
SAMPLE_CHARS = 24_000
#: Different letters that have a symbol of their own.
LETTERS = 60
BLOCK = 2_048
# characters walked at once
_BATCH = 1 << 23
_SPACE, _OTHER = 0, 1


@dataclass(frozen=True)
class Model:
    """``symbols``: the symbol of each code point; ``table``: next state and phrase mark by state and symbol."""

    languages: tuple[str, ...]
    symbols: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    @property
    def width(self) -> int:
        return self.table.shape[1]


# --- learning -------------------------------------------------------------------------------------------


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None) -> list[tuple[str, str]]:
    """``(language, piece)`` rows for learning: a bounded number per language, chosen by a hash of the text.

    Copies of a text, and texts of one piece, take one place, so the number is of different pieces. A piece is from
    anywhere in its text; where, the text's hash says.
    """
    order = F.xxhash64(docs[text]) if order is None else order
    start = F.pmod(F.xxhash64(F.lit("start"), docs[text]), F.greatest(F.char_length(docs[text]) - SAMPLE_PIECE + 1, F.lit(1)))
    piece = F.substring(docs[text], (start + 1).cast("int"), F.lit(SAMPLE_PIECE))
    pieces = docs.select(docs[lang].alias("lang"), piece.alias("piece"), order.alias("o"))
    pieces = pieces.where(F.col("lang").isNotNull() & (F.char_length("piece") > 0))
    # the places are chosen by hashes, so only the chosen pieces move; copies merge inside each task first
    pieces = pieces.withColumn("h", F.xxhash64("piece"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("o", "h"))
    distinct = pieces.groupBy("lang", "h").agg(F.min("o").alias("o"))
    chosen = distinct.withColumn("n", place).where(F.col("n") <= SAMPLE_TEXTS).select("lang", "h")
    rows = pieces.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect()
    return sorted((r.lang, r.piece) for r in rows)


def _symbols(texts: list[str]) -> np.ndarray:
    """The symbol of each code point: frequent letters have their own (upper case as lower), others share one."""
    counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
    table = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    chosen = sorted(counts, key=lambda c: (-counts[c], c))[:LETTERS]
    for symbol, letter in enumerate(chosen, _OTHER + 1):
        for form in {letter, letter.upper(), unicodedata.normalize("NFC", letter)}:
            if len(form) == 1:
                table[ord(form)] = symbol
    return table


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is its root."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p, last = last, new
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = edges[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        clone = len(edges)
        edges.append(dict(edges[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and edges[p].get(c) == q:
            edges[p][c] = clone
            p = link[p]
        link[q] = link[new] = clone
    return edges


def _parser(edges: list[dict[int, int]], width: int, base: int) -> np.ndarray:
    """Walking table: ``2 * next + mark``; the mark says that this symbol starts a phrase. The last symbol rests."""
    root = np.full(width, base, dtype=np.int64)
    for c, state in edges[0].items():
        root[c] = base + state
    table = np.tile(2 * root + 1, (len(edges), 1))
    for state, out in enumerate(edges[1:], 1):
        for c, to in out.items():
            table[state, c] = 2 * (base + to)
    table[:, width - 1] = 2 * (base + np.arange(len(edges)))
    return table


def learn(rows: list[tuple[str, str]]) -> Model:
    """A model of ``(language, text)`` rows; languages without a letter in their rows are not learned."""
    by_language: dict[str, list[str]] = {}
    for language, text in rows:
        by_language.setdefault(language, []).append(text)
    symbols = _symbols([text for _, text in rows])
    width = int(symbols.max(initial=_OTHER)) + 2
    languages, tables, roots, bits, base = [], [], [], [], 0
    for language in sorted(by_language):
        # the pieces take turns, so that each adds to the sample
        share = max(200, SAMPLE_CHARS // len(by_language[language]))
        codes = np.concatenate([_codes(t[:share], symbols)[0] for t in by_language[language]])[:SAMPLE_CHARS]
        if not codes.any():
            continue
        table = _parser(automaton(codes.tolist()), width, base)
        languages.append(language)
        tables.append(table)
        roots.append(base)
        bits.append(np.log2(len(codes) + 1))
        base += len(table)
    table = np.concatenate(tables).astype(np.int32) if tables else np.zeros((0, width), dtype=np.int32)
    return Model(tuple(languages), symbols, table, np.array(roots, dtype=np.int32), np.array(bits))


# --- predicting -----------------------------------------------------------------------------------------


def _codes(text: str, symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """The text's symbols, runs of anything but letters as one space; and its number of letters."""
    codes = symbols[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    letters = codes != _SPACE
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    return codes[keep], int(letters.sum())


def phrases(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text under each language (texts x languages), and letters of each text."""
    counts = np.zeros((len(texts), len(model.languages)), dtype=np.int64)
    letters = np.zeros(len(texts), dtype=np.int64)
    blocks: list[np.ndarray] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        codes, letters[i] = _codes(text, model.symbols)
        for start in range(0, len(codes), BLOCK):
            blocks.append(codes[start : start + BLOCK])
            owners.append(i)
            held += len(blocks[-1])
            if held >= _BATCH:
                _walk(blocks, owners, model, counts)
                blocks, owners, held = [], [], 0
    if blocks:
        _walk(blocks, owners, model, counts)
    return counts, letters


def _walk(blocks: list[np.ndarray], owners: list[int], model: Model, counts: np.ndarray) -> None:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    grid = np.full((len(blocks), lengths[0]), model.width - 1, dtype=np.uint8)
    for row, i in enumerate(order):
        grid[row, : lengths[row]] = blocks[i]
    steps = np.ascontiguousarray(grid.T)
    flat = model.table.reshape(-1)
    state = np.repeat(model.roots[:, None], len(blocks), axis=1)
    starts = np.zeros(state.shape, dtype=np.int32)
    # the blocks still running at step t are the first active[t]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    for t in range(lengths[0]):
        n = active[t]
        got = flat.take(state[:, :n] * model.width + steps[t, :n])
        starts[:, :n] += got & 1
        state[:, :n] = got >> 1
    np.add.at(counts, np.array(owners)[order], starts.T)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The score is the share by which the winner's entropy lies below the next one's, from 0 to 1 (1 if only one
    language was learned). Null texts, texts without a letter, and any text if nothing was learned: ``und``, 0.
    """
    counts, letters = phrases([t or "" for t in texts], model)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    entropy = counts * model.bits / np.maximum(letters, 1)[:, None]
    best = entropy.argmin(axis=1)
    rank = np.sort(entropy, axis=1)
    known = letters > 0
    score = np.ones(len(texts)) if rank.shape[1] == 1 else 1 - rank[:, 0] / np.maximum(rank[:, 1], 1e-12)
    names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
    return names, np.where(known, np.clip(score, 0, 1), 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns: the predicted language and its score. Rows stay where they are.

    Columns already named so are kept and the new ones get an underscore. Repeated rows get equal predictions.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list[pa.Array]:
        names, scores = predict(texts, shared.value)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return with_arrays(docs, text, {lang: StringType(), score: DoubleType()}, make)


def held_out(doc_id: Column, fold: int = 5) -> Column:
    """Whether a document is kept out of learning; one without an id is not, and is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % fold == 0, F.lit(False))


def learned_from(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model from the documents outside the held-out fold."""
    return learn(sample(docs.where(docs[doc_id].isNotNull() & ~held_out(docs[doc_id])), text, lang))


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The documents whose language can be told, with their own columns; null texts and those without a letter go.

    So do no others if nothing could be learned, as without a labelled text.
    """
    model = learned_from(docs, text, lang, doc_id)
    if not model.languages:
        return docs.where(docs[text].rlike(r"\p{L}"))
    found = identify(docs, model, text)
    return found.where(F.col(found.columns[-2]) != UNDETERMINED).select(*own_columns(docs))
