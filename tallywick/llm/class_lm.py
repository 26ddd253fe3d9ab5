"""Language-model scores by Brown's class-based bigrams.

Every word has one class; a word's probability is that of its class after the class before, times that of the word
within its class. Classes come from exchange clustering, which moves words to the class that makes the training text
likeliest:

* words that make up at least one token in ``SHARE`` (so at most ``SHARE`` of them) are exchanged one by one, on their
  counts beside each other and beside all rarer words together, until none moves;
* every rarer word is then exchanged once, on its counts beside the classes, all at the same class counts.

Counts are over all training documents. A task reads documents in blocks: a block's words are listed once, with their
counts, and its documents written to the shared folder as places in that list. So what is counted, joined and dealt to
tasks by word has a row per block and word, however common the word is; documents are not moved at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallywick.llm.storage import attempt_file, materialize, open_store, output_folder

CLASSES = 32
#: A frequent word is at least one token in so many.
SHARE = 2_000
#: Rounds of the exchange of frequent words, if words still move.
ROUNDS = 30
#: Weight, in tokens, of a class's overall share beside its counts after another class.
PRIOR = 5.0
#: Bytes of text in a block, one document at least.
BLOCK = 16 << 20
#: What the base adds to each count.
ADDED = 0.1

#: The end of a document is the empty word; it alone is in class 0. Rarer words begin in class 1.
END, REST = 0, 1


def held_out(doc_id: Column, fold: int = 10) -> Column:
    """Whether a document is kept out of learning; one without an id is not, and is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % fold == 0, F.lit(False))


# --- blocks ---------------------------------------------------------------------------------------------


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of the words of all texts, an end behind each text's; where texts begin; the words, the end first."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, parents = split.flatten(), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, parents = flat.filter(real), parents.filter(real).to_numpy()
    coded = flat.dictionary_encode()
    counts = np.bincount(parents, minlength=len(texts))
    ends = np.cumsum(counts)
    tokens = np.insert(coded.indices.to_numpy() + np.int32(1), ends, 0)
    starts = ends - counts + np.arange(len(texts))
    return tokens, starts, pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary])


def _write(uri: str, table: pa.Table) -> None:
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as sink:
        with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)


def _read(uri: str) -> pa.Table:
    store, path = open_store(uri)
    with store.open_input_file(path) as source:
        return pa.ipc.open_file(source).read_all()


def write_blocks(docs: DataFrame, folder: str, text: str, doc_id: str, train: Column, size: int = BLOCK) -> DataFrame:
    """Writes documents as places in their block's list of words; returns ``block, place, word, n``.

    ``block`` is a number that names its files, ``n`` how often its training documents have the word. Blocks count
    once their numbers are in this table, which Spark commits.
    """
    chosen = docs.select(
        docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for row, n in enumerate(lengths.tolist(), 1):
                total += n
                if total >= size:
                    held.append(batch.slice(start, row - start))
                    yield from _block(folder, held)
                    held, total, start = [], 0, row
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from _block(folder, held)

    return materialize(chosen.mapInArrow(run, "block long, place int, word string, n long"), "words")


def _name(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/block-{number:016x}"


def _block(folder: str, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    tokens, starts, words = _words(table["text"].combine_chunks())
    number = uuid.uuid4().int >> 65
    name = _name(folder, number)
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(tokens)).astype(np.int64)), pa.array(tokens))
    _write(f"{name}.arrow", pa.table({"doc_id": table["doc_id"], "train": table["train"], "tokens": lists}))
    _write(f"{name}.words.arrow", pa.table({"word": words}))
    learned = tokens[np.repeat(table["train"].to_numpy(), np.diff(np.append(starts, len(tokens))))]
    counts = np.bincount(learned, minlength=len(words))
    for at in range(0, len(words), 100_000):
        part = words.slice(at, 100_000)
        rows = len(part)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows, number, np.int64)), pa.array(np.arange(at, at + rows, dtype=np.int32)), part.cast(pa.string()),
                pa.array(counts[at : at + rows].astype(np.int64)),
            ],
            names=["block", "place", "word", "n"],
        )


class _Docs:
    """A block read back: its documents' tokens, and the tokens before them (an end before the first)."""

    def __init__(self, name: str, training_only: bool):
        table = _read(f"{name}.arrow")
        if training_only:
            table = table.filter(table["train"])
        self.ids, self.train = table["doc_id"].combine_chunks(), table["train"]
        lists = table["tokens"].combine_chunks()
        self.tokens = lists.flatten().to_numpy()
        self.counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        # every document ends in place 0, and begins behind an end
        self.before = np.concatenate([np.zeros(1, self.tokens.dtype), self.tokens])[:-1]


# --- clustering -----------------------------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(counts: np.ndarray) -> float:
    """What classes add to the log-likelihood of the training text, from the counts of neighbouring classes."""
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(axis=1)).sum() - _xlogx(counts.sum(axis=0)).sum())


def exchange(beside: np.ndarray, classes: np.ndarray, fixed: int, most: int = ROUNDS) -> np.ndarray:
    """Moves words (all but the first ``fixed``) to the class that raises :func:`likelihood` most, until none moves.

    ``beside[v, w]`` counts ``w`` after ``v``; ``classes`` are those to begin with. Class 0 takes no word. Of equal
    classes the present one stays, then the first is taken.
    """
    classes = classes.copy()
    c = int(classes.max()) + 1
    one = np.eye(c)[classes]
    after, before = beside @ one, beside.T @ one  # of each word, by class
    counts = one.T @ after
    for _ in range(most):
        moved = False
        for w in range(fixed, len(classes)):
            a, r, l, s = classes[w], after[w].copy(), before[w].copy(), beside[w, w]
            counts[a] -= r
            counts[:, a] -= l
            counts[a, a] += s
            r[a] -= s
            l[a] -= s
            k = _best(counts, r, l, s, a)
            if k != a:
                moved = True
                classes[w] = k
                for table, column in ((after, beside[:, w]), (before, beside[w])):
                    table[:, a] -= column
                    table[:, k] += column
            r[k] += s
            l[k] += s
            counts[k] += r
            counts[:, k] += l
            counts[k, k] -= s
        if not moved:
            break
    return classes


def _best(counts: np.ndarray, r: np.ndarray, l: np.ndarray, s: float, now: int) -> int:
    """The class that gains most by a word with ``r`` after and ``l`` before it, ``s`` times itself."""
    held = _xlogx(counts)
    gain = (_xlogx(counts + r) - held).sum(axis=1) + (_xlogx(counts + l[:, None]) - held).sum(axis=0)
    own = np.diag(counts)
    gain += _xlogx(own + r + l + s) + _xlogx(own) - _xlogx(own + r) - _xlogx(own + l)
    # the neighbours' own totals are the same wherever the word goes
    for totals, n in ((counts.sum(axis=1) + l, r.sum() + s), (counts.sum(axis=0) + r, l.sum() + s)):
        gain -= _xlogx(totals + n) - _xlogx(totals)
    gain[END] = -np.inf
    return now if gain[now] >= gain.max() - 1e-9 else int(gain.argmax())


def _gains(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``[i, side, c, k]``: what class ``k`` gains by ``n[i]`` more neighbours of class ``c`` after (0) or before (1).

    A word's counts are in class ``REST`` already, so there it is what they gain now.
    """
    n = n[:, None, None, None].astype(float)
    both = np.stack([counts.T, counts])[None]  # by neighbour's class, then by class
    added = _xlogx(both + n) - _xlogx(both)
    added[..., REST] = (_xlogx(both) - _xlogx(np.maximum(both - n, 0)))[..., REST]
    return added


# --- learning -------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Words with class and count, counts of neighbouring classes, and the sums over all training tokens."""

    lexicon: DataFrame
    counts: np.ndarray
    tokens: int
    types: int
    once: int


def _pairs(blocks: DataFrame, folder: str, tell: Callable, size: int) -> DataFrame:
    """``before, after, n`` of neighbouring tokens of the training documents; ``tell`` numbers a block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                name = _name(folder, block)
                docs, numbers = _Docs(name, True), tell(name)
                met = np.bincount(numbers[docs.before].astype(np.int64) * size + numbers[docs.tokens], minlength=1)
                at = np.flatnonzero(met)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(met[at])],
                    names=["before", "after", "n"],
                )

    return blocks.mapInArrow(run, "before int, after int, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


def _matrix(pairs: DataFrame, size: int) -> np.ndarray:
    """Pairs as a table on the driver: ``size`` squared numbers at most."""
    found = pairs.toArrow()
    table = np.zeros((size, size))
    table[found["before"].to_numpy(), found["after"].to_numpy()] = found["n"].to_numpy()
    return table


def _contexts(blocks: DataFrame, folder: str, tell: Callable, classes: np.ndarray, c: int) -> DataFrame:
    """``word, near`` of rarer words in training documents: their neighbours' classes and counts, packed.

    ``classes`` are those of the words that ``tell`` numbers, of rarer ones last. A number of ``near`` is the count
    times ``2 * c``, plus the class, plus ``c`` if it stands before the word.
    """
    rest = len(classes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                name = _name(folder, block)
                docs, numbers = _Docs(name, True), tell(name)
                kind = classes[numbers]
                token, before = docs.tokens, docs.before
                rare = np.flatnonzero(numbers[token] == rest)
                # a rarer word is no end, so there is a token behind it
                word = token[rare].astype(np.int64) * (2 * c)
                near, times = np.unique(np.concatenate([word + kind[token[rare + 1]], word + c + kind[before[rare]]]), return_counts=True)
                place, packed = near // (2 * c), times * (2 * c) + near % (2 * c)
                first = np.flatnonzero(np.diff(place, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)).astype(np.int32)), pa.array(packed))
                words = _read(f"{name}.words.arrow")["word"].combine_chunks().take(pa.array(place[first])).cast(pa.string())
                for at in range(0, len(words), 100_000):
                    yield pa.RecordBatch.from_arrays([words.slice(at, 100_000), lists.slice(at, 100_000)], names=["word", "near"])

    return blocks.mapInArrow(run, "word string, near array<long>")


def _assigned(contexts: DataFrame, counts: np.ndarray) -> DataFrame:
    """``word, class, n`` of rarer words: each moved to the class that gains most, all at the same class counts."""
    c = len(counts)
    small = _gains(counts, np.arange(1, 17)).reshape(16, 2 * c, c)
    totals = counts.sum(axis=1)

    def merged(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of sorted rows, and their neighbours: ``word's place * 2 * c + neighbour`` and how often."""
        table = pa.Table.from_batches(held).combine_chunks()
        words, lists = table["word"].combine_chunks(), table["near"].combine_chunks()
        changes = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
        word = np.cumsum(np.concatenate([[0], changes]))
        packed = lists.flatten().to_numpy()
        near = word[pc.list_parent_indices(lists).to_numpy()] * (2 * c) + packed % (2 * c)
        near, at = np.unique(near, return_inverse=True)
        times = np.bincount(at, packed // (2 * c)).astype(np.int64)
        return words.take(pa.array(np.flatnonzero(np.diff(word, prepend=-1)))), near, times

    def packed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        """Rows of one word as one row."""
        words, near, times = merged(held)
        lists = pa.array([(times * (2 * c) + near).tolist()], pa.list_(pa.int64()))
        return [pa.RecordBatch.from_arrays([words.cast(held[0].schema.field(0).type), lists], names=["word", "near"])]

    def choose(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        words, near, times = merged(held)
        gains = small[np.minimum(times, 16) - 1, near % (2 * c)]
        for i in np.flatnonzero(times > 16):
            gains[i] = _gains(counts, times[i : i + 1]).reshape(2 * c, c)[near[i] % (2 * c)]
        first = np.flatnonzero(np.diff(near // (2 * c), prepend=-1))
        gain = np.add.reduceat(gains, first)
        # every token has one neighbour behind it
        n = np.add.reduceat(np.where(near % (2 * c) < c, times, 0), first)[:, None]
        added = _xlogx(totals + n) - _xlogx(totals)
        added[:, REST] = (_xlogx(totals) - _xlogx(np.maximum(totals - n, 0)))[:, REST]
        gain -= 2 * added
        gain[:, END] = -np.inf
        return pa.RecordBatch.from_arrays(
            [words.cast(pa.string()), pa.array(gain.argmax(axis=1).astype(np.int32)), pa.array(n[:, 0])], names=["word", "class", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of words, of which the last may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.cast(pa.schema([("word", pa.string()), ("near", pa.list_(pa.int64()))]))
            words = batch.column(0)
            cut = pc.index(words, words[-1]).as_py()
            if cut:
                yield choose([*held, batch.slice(0, cut)])
                held = []
            elif held and held[0].column(0)[0] != words[0]:
                yield choose(held)
                held = []
            held = packed([*held, batch.slice(cut)])
        if held:
            yield choose(held)

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, class int, n long")


def learn(words: DataFrame, folder: str, classes: int = CLASSES, share: int = SHARE) -> Model:
    """The model of the training documents whose blocks are in ``words`` (see :func:`write_blocks`); its class counts
    are those of the words it began with (see :func:`with_classes`)."""
    c = max(classes, 2)
    tokens = words.agg(F.sum("n")).first()[0] or 0
    counted = words.where(F.col("n") > 0).groupBy("word").agg(F.sum("n").alias("n"))
    often = F.collect_list(F.when((F.col("n") * share >= tokens) & (F.col("word") != ""), F.struct("n", "word")))
    types, once, found = counted.agg(F.count(F.lit(1)), F.count_if(F.col("n") == 1), often).first()
    frequent = sorted(((r["n"], r["word"]) for r in found), key=lambda r: (-r[0], r[1]))
    # the end, the frequent words, all others
    listed = pa.array(["", *(w for _, w in frequent)], pa.large_string())
    size = len(listed) + 1

    def tell(name: str) -> np.ndarray:
        at = pc.index_in(_read(f"{name}.words.arrow")["word"].combine_chunks(), listed)
        return pc.fill_null(at, size - 1).to_numpy()

    blocks = materialize(words.where(F.col("place") == 0).select("block"), "blocks")
    blocks = blocks.repartition(max(1, blocks.count()))
    beside = _matrix(_pairs(blocks, folder, tell, size), size)
    order = np.r_[0, size - 1, 1 : size - 1]  # first the two that stay
    begun = np.full(size, REST)
    begun[0] = END
    begun[2:c] = np.arange(2, c)[: size - 2]
    own = np.empty(size, np.int64)
    own[order] = exchange(beside[np.ix_(order, order)], begun, 2)
    one = np.eye(c)[own]
    counts = one.T @ beside @ one
    rare = _assigned(_contexts(blocks, folder, tell, own, c), counts)
    known = [("", END, int(beside[:, 0].sum()))] + [(w, int(k), n) for (n, w), k in zip(frequent, own[1:])]
    rows = words.sparkSession.createDataFrame([k for k in known if k[2]], "word string, class int, n long")
    return Model(materialize(rare.unionByName(rows), "lexicon"), counts, tokens, types, once)


# --- scores ---------------------------------------------------------------------------------------------


def with_classes(words: DataFrame, model: Model, folder: str) -> tuple[DataFrame, Model]:
    """Writes the class and count of every block's words beside its documents.

    Returns ``block, name``, and the model with the counts of neighbouring classes over all training tokens.
    """
    c = len(model.counts)
    found = words.select("block", "place", "word").join(model.lexicon, "word", "left").select("block", "place", "class", "n")
    by_block = found.repartition("block").sortWithinPartitions("block", "place")

    def written(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        kind = pc.fill_null(table["class"], c).to_numpy()  # a class of its own for words unseen in training
        path = attempt_file(folder, "classes", ".arrow")
        _write(path, pa.table({"class": kind.astype(np.int16), "n": pc.fill_null(table["n"], 0)}))
        docs = _Docs(_name(folder, block), True)
        met = np.bincount(kind[docs.before].astype(np.int64) * (c + 1) + kind[docs.tokens], minlength=(c + 1) ** 2)
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([path]), pa.array([met.tolist()], pa.list_(pa.int64()))], names=["block", "name", "met"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if block is not None and numbers[start] != block:
                    yield written(block, held)
                    held = []
                block = int(numbers[start])
                held.append(batch.slice(start, end - start))
        if block is not None:
            yield written(block, held)

    made = materialize(by_block.mapInArrow(run, "block long, name string, met array<long>"), "classes")
    met = made.select(F.posexplode("met").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    pairs = met.select((F.col("at") / (c + 1)).cast("int").alias("before"), (F.col("at") % (c + 1)).alias("after"), "n")
    return made.select("block", "name"), replace(model, counts=_matrix(pairs, c + 1)[:c, :c])


def tables(model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Log10 of a class after a class (after an unknown word: overall), tokens per class, and an unknown word's share.

    A class's counts after another are smoothed by its overall share; words unseen in training are one type, as likely
    as a word seen once; all others share what is left.
    """
    counts, total = model.counts, max(model.tokens, 1)
    sizes = counts.sum(axis=0)
    overall = sizes / total
    after = (counts + PRIOR * overall) / (counts.sum(axis=1, keepdims=True) + PRIOR)
    with np.errstate(divide="ignore"):
        logs = np.log10(np.vstack([after, overall]))
    return logs, sizes, (model.once + ADDED) / (model.tokens + ADDED * (model.types + 1))


def scores(made: DataFrame, model: Model, folder: str, kind: str = "long") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, perplexity`` of every document of the blocks in ``made``."""
    logs, sizes, unseen = tables(model)
    c = len(sizes)
    smoothed = model.tokens + ADDED * (model.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs, table = _Docs(_name(folder, block), False), _read(path)
                kinds, n = table["class"].to_numpy().astype(np.int64), table["n"].to_numpy()
                base = np.log10((n + ADDED) / smoothed)
                with np.errstate(divide="ignore", invalid="ignore"):
                    within = np.where(n > 0, np.log10(n / np.append(sizes, 1)[kinds]) + np.log10(1 - unseen), np.log10(unseen))
                padded = np.hstack([logs, np.zeros((c + 1, 1))])  # nothing to add for an unknown word
                each = padded[kinds[docs.before], kinds[docs.tokens]] + within[docs.tokens]
                score = np.add.reduceat(each, docs.starts)
                columns = [
                    docs.ids, pa.array(docs.counts), pa.array(np.add.reduceat((n > 0)[docs.tokens].astype(np.int64), docs.starts)),
                    pa.array(np.add.reduceat(base[docs.tokens], docs.starts)), pa.array(score), pa.array(10 ** (-score / docs.counts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double"
    names = [f.split()[0] for f in schema.split(", ")]
    return made.repartition(max(1, made.count())).mapInArrow(run, schema)


def class_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", classes: int = CLASSES, size: int = BLOCK) -> DataFrame:
    """Scores every document with a model of those that are not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``; scores are log10.

    * Null and empty texts have the end only. Rows that repeat are documents of their own; those without an id are scored,
      not learned from. Other columns are not read. An empty table gives an empty result.
    * If nothing is learned, every token is an unknown word, the only type there is: all scores are 0.
    * A task holds a block; a longer text is a block of its own.
    """
    folder = output_folder(docs.sparkSession, "blocks")
    words = write_blocks(docs, folder, text, doc_id, F.crc32(docs[doc_id].cast("string")) % 10 != 0, size)
    made, model = with_classes(words, learn(words, folder, classes), folder)
    found = scores(made, model, folder, docs.schema[doc_id].dataType.simpleString())
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity",
    )
