"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits in lower case. A document overlaps an item if, laid over it in some place, at
least ``NEED`` of ``WINDOW`` consecutive words agree; the others may be substituted. Fixed masks choose the words of
a place that are hashed, and ignore the rest. The masks are such that any window with ``WINDOW - NEED`` substitutions
holds a hit of one of them (tested for every pattern), so the join of test and training hashes loses nothing. Hits only
say how a document lies over an item; each such lay is kept once, and compared word by word from end to end.

Items of fewer than ``NEED`` words have no such window. They overlap a document that holds all their words in a row, from
``SHORTEST`` words on; still shorter ones, which clean texts hold by chance, only a document of just these words.

DataFrame functions only: one scan of the documents is hashed and joined without their texts, however many hits a
text has, and a second one meets the items of the documents with hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywick.llm.storage import free_names, materialize, own_columns

WINDOW = 12
NEED = 10
SHORTEST = 5
#: Words that count (1) and words that are ignored (0).
SEEDS = ("11111", "1110111", "11011011")
#: Long items are cut into pieces of so many words, which overlap by so many.
PIECE, OVERLAP = 4_096, 256
#: Items of so many words in all are sent to all tasks: three hashes of 24 bytes for each, some 25 MB with the words.
BLOCK_WORDS = 200_000
#: Beyond that, places of documents are kept if their hash is one of a set of so many bits (8 MB), and move.
BITS = 1 << 26


def words_of(text: Column) -> Column:
    """The words of a text; one empty word if it has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.split(F.trim(plain), " ")


def _placed(df: DataFrame, words: str, at: str, seeds: dict[int, str]) -> DataFrame:
    """A row for each place of ``words`` and mask that fits there, with its hash; the words themselves stay behind."""
    kept = [c for c in df.columns if c != words]
    shortest = min(map(len, seeds.values()))
    places = F.when(F.size(words) >= shortest, F.sequence(F.lit(0), F.size(words) - shortest))
    rows = df.select(*kept, words, F.explode(places).alias(at))
    hashes = []
    for number, seed in seeds.items():
        chosen = [F.get(words, F.col(at) + i) for i, used in enumerate(seed) if used == "1"]
        hashes.append(F.when(F.col(at) + len(seed) <= F.size(words), F.xxhash64(F.lit(number), *chosen)))
    return rows.select(*kept, at, F.explode(F.array(*hashes)).alias("hash")).where(F.col("hash").isNotNull())


def _whole(words: int) -> dict[int, str]:
    """The mask for items of so many words, all of which count."""
    return {100 + words: "1" * words}


def _possible(places: DataFrame, seeds: DataFrame) -> DataFrame:
    """The places whose hash may be one of the items': each hash is a bit in an array of fixed size."""
    slot = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    bit = F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")
    held = seeds.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = seeds.sparkSession.range(BITS >> 6).join(held, "id", "left")
    cells = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("cells"))
    word = F.get(cells.select("cells.bits").scalar(), F.shiftright(slot, 6).cast("int"))
    marked = places.withColumn("bits", word).where("shiftright(bits, CAST(hash & 63 AS INT)) & 1L = 1")
    return marked.drop("bits")


def _lays(places: DataFrame, seeds: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """How documents lie over pieces of items: ``shift`` is a word's place in the text less that in the piece.

    A text of one word repeated lies over such an item in as many ways as both have words, not as many as there are
    pairs of places: hits are made distinct where they arise.
    """
    if broadcast:
        hits = places.join(F.broadcast(seeds), "hash")
    else:
        hits = _possible(places, seeds).join(seeds, "hash")
    lays = hits.select(*keys, "piece", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    return lays.groupBy(*keys, "piece").agg(F.collect_list("shift").alias("shifts"))


def _compared() -> Column:
    """The most words that agree in a window of any lay, and where the first lay with enough of them begins.

    The last ``WINDOW`` comparisons along a lay are bits of a number, above them the most that have agreed so far. Lays
    are taken from the least shift on; once all words of a window agree, no other can have more.
    """
    same = "CASE WHEN get(doc_words, i + shift) = get(item_words, i) THEN 1L ELSE 0L END"
    places = "sequence(greatest(0, -shift), least(size(item_words), size(doc_words) - shift) - 1)"
    bits = f"((a * 2) & {(1 << WINDOW) - 1}) + agrees"
    step = f"(greatest(a div {1 << WINDOW}, bit_count({bits})) * {1 << WINDOW}) + ({bits})"
    most = f"aggregate(transform({places}, i -> {same}), 0L, (a, agrees) -> {step}) div {1 << WINDOW}"
    found = "named_struct('most', greatest(f.most, m), 'place', CASE WHEN f.place IS NULL AND m >= need THEN greatest(0, shift) ELSE f.place END)"
    # a list of one, to name its element
    taken = f"get(transform(array(CAST({most} AS INT)), m -> {found}), 0)"
    top = f"least({WINDOW}, size(item_words), size(doc_words))"
    start = "named_struct('most', 0, 'place', CAST(NULL AS INT))"
    return F.expr(f"aggregate(array_sort(shifts), {start}, (f, shift) -> CASE WHEN f.most >= {top} THEN f ELSE {taken} END)")


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    keys: list[str] | None = None,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """A row per document (its ``keys``; the id, if not given) and item that overlap: ``item_id, agreeing, place``.

    ``agreeing`` is the most words that agree in a window, ``place`` the word where the item, laid over the document as
    far to the front as it has enough, begins.

    * Items of equal words are one, under their least id. Null and empty texts overlap nothing.
    * Rows with equal keys count as one document. Other columns are not read. Empty tables give an empty result.
    * Documents are scanned and hashed once, for any number of items; up to ``BLOCK_WORDS`` words of items are sent to all
      tasks, beyond that the places that may be hits are dealt by their hash.
    """
    keys = keys or ["doc_id"]
    given = (
        items.select(items[item_id].alias("item_id"), words_of(items[item_text]).alias("all_words"))
        .where(F.col("all_words") != F.array(F.lit("")))
        .groupBy("all_words")
        .agg(F.min("item_id").alias("item_id"))
    )
    pieces = materialize(
        given.withColumn("start", F.explode(F.expr(f"sequence(0, greatest(size(all_words) - {OVERLAP + 1}, 0), {PIECE - OVERLAP})")))
        .select("item_id", F.slice("all_words", F.col("start") + 1, F.lit(PIECE)).alias("item_words"))
        .withColumn("piece", F.xxhash64("item_words"))
        .withColumn("need", F.least(F.size("item_words"), F.lit(NEED))),
        "pieces",
    )
    size = F.size("item_words")
    total, short = pieces.agg(F.sum(size), F.collect_set(F.when((size >= SHORTEST) & (size < NEED), size))).first()
    total = total or 0

    masks = dict(enumerate(SEEDS))
    seeds = _placed(pieces.where(size >= NEED).select("piece", "item_words"), "item_words", "item_at", masks)
    for n in sorted(short):
        seeds = seeds.unionByName(_placed(pieces.where(size == n).select("piece", "item_words"), "item_words", "item_at", _whole(n)))
        masks |= _whole(n)

    names = [f"key{i}" for i in range(len(keys))]
    rows = docs.select(*(docs[k].alias(n) for k, n in zip(keys, names)), words_of(docs[text]).alias("doc_words"))
    small = total <= BLOCK_WORDS
    lays = materialize(_lays(_placed(rows, "doc_words", "at", masks), seeds, names, small), "lays")
    renamed = lays.toDF(*(f"hit_{n}" for n in names), "piece", "shifts")
    same = [F.col(n).eqNullSafe(F.col(f"hit_{n}")) for n in names]
    laid = renamed.join(F.broadcast(pieces) if small else pieces, "piece").join(rows, same)
    found = laid.withColumn("found", _compared()).select(
        *names, "item_id", "need", F.col("found.most").alias("agreeing"), "found.place"
    )
    # a document of nothing else than an item of a few words
    tiny = pieces.where(size < SHORTEST).select("item_id", "need", "item_words")
    equal = rows.where(F.size("doc_words") < SHORTEST).join(tiny, F.col("doc_words") == F.col("item_words"))
    found = found.unionByName(equal.select(*names, "item_id", "need", F.col("need").alias("agreeing"), F.lit(0).alias("place")))
    return (
        found.where(F.col("agreeing") >= F.col("need"))
        .groupBy(*names, "item_id")
        .agg(F.max("agreeing").alias("agreeing"), F.min("place").alias("place"))
        .select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "item_id", "agreeing", "place")
    )


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that overlap no item, with their own columns; rows that repeat share their fate."""
    content, bad_id, bad_content = free_names(docs, "content", "bad_id", "bad_content")
    marked = docs.withColumn(content, F.xxhash64(docs[text]))
    bad = overlaps(marked, items, [doc_id, content], text).select(F.col(doc_id).alias(bad_id), F.col(content).alias(bad_content))
    match = F.col(doc_id).eqNullSafe(F.col(bad_id)) & (F.col(content) == F.col(bad_content))
    return marked.join(bad.distinct(), match, "left_anti").select(*own_columns(docs))
