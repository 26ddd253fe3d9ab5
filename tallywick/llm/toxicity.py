"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary labelled text, another on what toxic labelled text has of its own:
words that many toxic texts share and ordinary ones hardly have (most words of a toxic text are ordinary). Every
window of a text is compressed with the ordinary dictionary alone and with both. What the toxic one saves, window
by window, makes a few figures per text, and a logistic curve fitted on texts outside the dictionaries turns them
into a score whose threshold is calibrated to 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from tallywick.llm.storage import materialize, with_arrays

#: Bounds of the training sample: texts of each label, and characters of each that dictionaries are made from.
SAMPLE_TEXTS = {1: 2_000, 0: 4_000}
SAMPLE_CHARS = 4_000
#: Tasks that make the figures of the sample's whole texts.
SAMPLE_TASKS = 48
ORDINARY_BYTES, TOXIC_BYTES = 1 << 16, 1 << 15
#: Words of a window.
WINDOW = 6
#: A toxic text's own words: in so many toxic texts, at least this share of them, and so many times as often.
OWN_TEXTS, OWN_SHARE, OWN_RATIO = 6, 0.01, 20.0
FOLDS = 3
#: Means count so many further windows of so many bytes without a saving, so that one window makes no short text toxic.
PRIOR_WINDOWS, PRIOR_BYTES = 4, 40
# windows compressed before their figures are summed
_BLOCK = 1 << 14
_FEATURES = 6


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    offset: float


# --- windows --------------------------------------------------------------------------------------------


def _parameters() -> zstandard.ZstdCompressionParameters:
    # matches of five bytes and more, so that short common stretches don't count
    return zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_DFAST, min_match=5, window_log=18, hash_log=17, chain_log=17, search_log=4,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = _parameters()
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=parameters)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def features(text: str | None, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """What the toxic dictionary saves: most in a window, and damped means over all windows. Zeros without words."""
    alone, both = _compressor(ordinary).compress, _compressor(ordinary + toxic).compress
    words = (text or "").lower().split()
    most = windows = saved = gained = over_two = over_three = before = 0
    for start in range(0, len(words), WINDOW * _BLOCK):
        stop = min(len(words), start + WINDOW * _BLOCK)
        parts = [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(start, stop, WINDOW)]
        plain = np.fromiter((len(alone(p)) for p in parts), dtype=np.int64, count=len(parts))
        gain = plain - np.fromiter((len(both(p)) for p in parts), dtype=np.int64, count=len(parts))
        most = max(most, int(gain.max()))
        windows += len(parts)
        saved += int(gain.sum())
        gained += int(np.maximum(gain, 0).sum())
        over_two += int((gain >= 2).sum())
        over_three += int((gain >= 3).sum())
        before += int(plain.sum())
    if not windows:
        return np.zeros(_FEATURES)
    n = windows + PRIOR_WINDOWS
    means = [saved / n, over_two / n, over_three / n, gained / (before + PRIOR_WINDOWS * PRIOR_BYTES)]
    return np.array([min(most, 12), *means, np.log1p(windows)])


# --- learning -------------------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """``h``, ``label`` and whole ``text`` of the rows for learning, a bounded number of each label chosen by a hash of the id.

    The ids are chosen from the labels alone, so only the chosen texts move. Copies have the same ``h``.
    """
    marked = labels.select(labels[doc_id].alias("doc_id"), labels[toxic].cast("int").alias("label")).where("doc_id IS NOT NULL")
    picked = [
        marked.where(F.col("label") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for label, most in SAMPLE_TEXTS.items()
    ]
    texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).where(F.char_length("text") > 0)
    chosen = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    chosen = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("text").alias("h"), "label", "text")
    return materialize(chosen.groupBy("h", "label").agg(F.min("text").alias("text")), "labelled_texts")


def pieces(chosen: DataFrame) -> list[tuple[int, int, str]]:
    """``(h, label, piece)`` of the sample: at most ``SAMPLE_CHARS`` characters from anywhere in the text, by its hash."""
    room = F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0))
    piece = F.substring("text", F.pmod("h", room + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    return sorted((r.h, r.label, r.piece) for r in chosen.select("h", "label", piece.alias("piece")).collect())


def whole_figures(chosen: DataFrame, folds: dict[int, int], pairs: list[tuple[bytes, bytes]]) -> dict[int, np.ndarray]:
    """The figures of whole texts by ``h``, each with the dictionaries that its fold has no part in; made in tasks."""
    shared = chosen.sparkSession.sparkContext.broadcast((folds, pairs))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, dictionaries_of = shared.value
        for batch in batches:
            hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x = [features(t, *dictionaries_of[of[h]]).tolist() for h, t in zip(hashes, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["h", "x"])

    rows = chosen.select("h", "text").repartition(SAMPLE_TASKS, "h").mapInArrow(make, "h long, x array<double>").collect()
    return {r.h: np.array(r.x) for r in rows}


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
        return b"".join(samples)[-size:]


def dictionaries(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """The contents of the ordinary and of the toxic dictionary."""
    texts = [(text.lower().split(), label) for text, label in rows]
    n = {label: max(1, sum(1 for _, x in texts if x == label)) for label in (0, 1)}
    seen = {label: Counter(w for words, x in texts if x == label for w in set(words)) for label in (0, 1)}
    least = max(OWN_TEXTS, OWN_SHARE * n[1])
    own = {w for w, c in seen[1].items() if c >= least and c / n[1] >= OWN_RATIO * (seen[0][w] + 0.5) / n[0]}
    ordinary = [f" {' '.join(w[i : i + 30])} ".encode() for w, x in texts if x == 0 for i in range(0, len(w), 30)]
    kept = (f" {' '.join(w for w in words if w in own)} ".encode() for words, x in texts if x == 1)
    toxic = [k[i : i + 200] for k in kept if len(k) > 2 for i in range(0, len(k), 200)]
    # every so manieth window of the ordinary ones is sample enough
    return _trained(ordinary[:: max(1, len(ordinary) // 40_000)], ORDINARY_BYTES), _trained(toxic, TOXIC_BYTES)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge logistic regression, by Newton's method."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    penalty = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Where marking everything above gives the best balance of precision and recall."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    balance = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(np.diff(z[order]) != 0, True)
    best = int(np.argmax(np.where(ends, balance, -1)))
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    return float((z[order][best] + below) / 2)


def learn(rows: list[tuple[str, int]], folds: np.ndarray | None = None, figures: Callable[[list], np.ndarray] | None = None) -> Model:
    """A model of ``(text, label)`` rows; without rows of both labels it scores every text 0.

    ``folds`` has the fold of each row. ``figures`` gives the rows' figures from each fold's pair of dictionaries, if the
    rows are only pieces of their texts; the curve and the threshold are for whole texts.
    """
    y = np.array([label for _, label in rows], dtype=float)
    if len(set(y)) < 2 or len(rows) < 2 * FOLDS:
        return Model(b"", b"", (0.0,) * _FEATURES, (1.0,) * _FEATURES, (0.0,) * _FEATURES, -30.0)
    folds = np.arange(len(rows)) % FOLDS if folds is None else folds
    pairs = [dictionaries([r for r, f in zip(rows, folds) if f != fold]) for fold in range(FOLDS)]
    x = np.array([features(t, *pairs[f]) for (t, _), f in zip(rows, folds)]) if figures is None else figures(pairs)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights, offset = _logistic((x - center) / scale, y)
    z = (x - center) / scale @ weights + offset
    ordinary, toxic = dictionaries(rows)
    return Model(ordinary, toxic, tuple(center), tuple(scale), tuple(weights), offset - _threshold(z, y))


# --- scoring --------------------------------------------------------------------------------------------


def score(text: str | None, model: Model) -> float:
    """From 0 to 1, higher the likelier toxic; null and empty texts score as texts without windows."""
    x = (features(text, model.ordinary, model.toxic) - model.center) / np.array(model.scale)
    return float(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights) + model.offset, -30, 30))))


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text``; a column of that name is kept and the new one gets an underscore."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list[pa.Array]:
        return [pa.array([score(t, shared.value) for t in texts], pa.float64())]

    return with_arrays(docs, text, {name: DoubleType()}, make)


def held_out(doc_id: Column, fold: int = 5) -> Column:
    """Whether a document is kept out of learning; one without an id is not, and is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % fold == 0, F.lit(False))


def learned_from(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> Model:
    """A model from the labelled documents outside the held-out fold."""
    chosen = sample(docs, labels.where(~held_out(labels[doc_id])), text, doc_id, toxic)
    rows = pieces(chosen)
    # copies share a fold, whatever their labels
    of = {h: i % FOLDS for i, h in enumerate(sorted({h for h, _, _ in rows}))}

    def figures(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
        found = whole_figures(chosen, of, pairs)
        return np.array([found[h] for h, _, _ in rows])

    return learn([(piece, label) for _, label, piece in rows], np.array([of[h] for h, _, _ in rows]), figures)
