"""Secret scans: wide candidate search, then a random forest that removes false findings.

Candidates are long runs of the characters that keys and tokens are made of. Each has figures on its length, the
transitions between its characters, how much of it the corpus's own dictionary covers, whether it is part of a path,
and the words around it. A forest trained on labelled findings decides which stay.

DataFrame and SQL functions and Spark's forest only; texts are read in place and never moved.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tallywick.llm.storage import materialize

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}"
#: Words that announce a credential.
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api[_-]?key|access[_-]?key|private|auth|bearer|credential)"
#: Bounds of training: labelled findings of each kind, trees and their depth.
TRAIN_ROWS, TREES, DEPTH = 10_000, 40, 8
#: How often a letter triple has to occur to be part of the dictionary; there are 26 cubed of them at most.
COMMON = 3
_NEAR = 3
#: What made-up keys consist of.
ALPHABETS = tuple(
    "".join(map(chr, (c for first, last in kind for c in range(ord(first), ord(last) + 1))))
    for kind in (("09", "af"), ("AZ", "27"), ("az", "09"), ("AZ", "az", "09"), ("AZ", "az", "09", "//", "++"), ("AZ",), ("AZ", "az"))
)
#: A finding is plain if the dictionary covers this share of it, or if it is a path of words.
COVERED, PATH = 0.8, "^[/_+-]*[A-Z]?[a-z]+([/_+-]+[A-Z]?[a-z]+)+[/_+-]*$"
#: What the forest sees. Not among it: ``announced``, ``announced_near``, ``assigned`` and ``digits``, which make a
#: finding's label, and ``quoted``, which goes with them.
FEATURES = (
    "length", "upper", "other", "switches", "distinct", "pairs", "coverage", "slash", "url", "address", "dotted", "plain_near",
)


def _words(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row per word, next to its text's words; nothing is copied until a row is kept."""
    split = docs.select(*keys, F.split(F.coalesce(docs[text], F.lit("")), r"\s+").alias("words"))
    return split.select(*keys, "words", F.posexplode("words").alias("place", "word"))


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``triple``: the letter triples of the words of all documents, without the rare ones."""
    words = _words(docs, [], text).select(F.lower("word").alias("word")).where(F.col("word").rlike("^[a-z]{3,24}$"))
    triples = words.select("word", F.explode(F.expr("sequence(1, length(word) - 2)")).alias("i"))
    counted = triples.groupBy(F.substring("word", F.col("i"), F.lit(3)).alias("triple")).count()
    return counted.where(F.col("count") >= COMMON).select("triple")


def candidates(docs: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """A row per candidate: ``keys`` (the id, if not given), ``place`` of its word, ``number`` in the word, itself.

    Null and empty texts have none; a repeated row has its candidates again.
    """
    keys = keys or ["doc_id"]
    found = _words(docs, keys, text).where((F.length("word") >= 16) & F.col("word").rlike(CANDIDATE))
    near = [F.coalesce(F.get("words", F.col("place") - i), F.lit("")) for i in range(_NEAR, 0, -1)]
    after = [F.coalesce(F.get("words", F.col("place") + i), F.lit("")) for i in range(1, _NEAR + 1)]
    return found.select(
        *keys,
        "place",
        "word",
        F.concat_ws(" ", *near).alias("before"),
        F.concat_ws(" ", *after).alias("after"),
        F.posexplode(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"))).alias("number", "candidate"),
    )


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def with_features(found: DataFrame, triples: DataFrame) -> DataFrame:
    """Candidates with a column for each of ``FEATURES`` and of the context; ``triples`` has at most 26 cubed rows."""
    covered = (
        found.select("candidate")
        .distinct()
        .select("candidate", F.explode(F.expr("sequence(1, length(candidate) - 2)")).alias("i"))
        .select("candidate", F.lower(F.substring("candidate", F.col("i"), F.lit(3))).alias("triple"))
        .join(F.broadcast(triples), "triple")
        .groupBy("candidate")
        .agg(F.count("*").alias("covered"))
    )
    last = F.element_at(F.split("before", " "), -1)
    lead, tail = F.expr("substring_index(word, candidate, 1)"), F.expr("substring_index(word, candidate, -1)")
    flags = {
        "slash": F.col("word").rlike(r"[/\\]"),
        "url": F.col("word").rlike(r"://|^www\."),
        "address": F.col("word").contains("@"),
        "dotted": F.col("word").rlike(r"\w\.\w"),
        "announced": F.col("word").rlike(CREDENTIAL) | last.rlike(CREDENTIAL),
        "announced_near": F.col("before").rlike(CREDENTIAL),
        "assigned": last.rlike("[=:]$") | lead.rlike("[=:][\"']?$"),
        "quoted": lead.rlike("[\"'`]$") & tail.rlike("^[\"'`]"),
    }
    # ways through the characters: changes of kind, different characters, different neighbours
    switches = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    pairs = F.expr("size(array_distinct(transform(sequence(1, length(candidate) - 1), i -> substring(candidate, i, 2))))")
    near = F.concat_ws(" ", "before", "after")
    return (
        found.join(covered, "candidate", "left")
        .withColumns({name: flag.cast("double") for name, flag in flags.items()})
        .withColumns(
            {
                "length": F.length("candidate").cast("double"),
                "digits": _share("[0-9]"),
                "upper": _share("[A-Z]"),
                "other": _share("[^A-Za-z0-9]"),
                "switches": F.regexp_count("candidate", F.lit(switches)) / F.length("candidate"),
                "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
                "pairs": pairs / (F.length("candidate") - 1),
                "coverage": F.coalesce("covered", F.lit(0)) / (F.length("candidate") - 2),
                # of the words around it that have a letter or digit, so that "token =" looks no other than two words
                "plain_near": F.regexp_count(near, F.lit(r"\b\p{L}{2,}\b")) / F.greatest(F.regexp_count(near, F.lit(r"\S*[\p{L}\p{N}]\S*")), F.lit(1)),
            }
        )
        .drop("covered")
    )


def _announced() -> Column:
    return F.col("announced_near") + F.col("announced") > 0


def labelled_findings(found: DataFrame) -> DataFrame:
    """Candidates with a ``label``, as a reviewer's rule gives it; those the rule leaves open are not in the result.

    1: announced by a credential's name, assigned, and of digits and letters. 0: neither announced nor assigned, and a
    number, a path of words or well covered by the dictionary. A key that stands alone in open text is left open.
    """
    mixed = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    named = _announced()
    plain = ~F.col("candidate").rlike("[A-Za-z]") | F.col("candidate").rlike(PATH) | (F.col("coverage") >= COVERED)
    label = F.when(named & (F.col("assigned") > 0) & mixed, 1.0).when(~named & (F.col("assigned") == 0) & plain, 0.0)
    return found.withColumn("label", label).where(F.col("label").isNotNull())


def planted_keys(plain: DataFrame) -> DataFrame:
    """Each finding with a made-up key in its place, of an alphabet and a length that hang on its ``key``."""
    i = F.pmod(F.shiftright("key", 8), F.lit(len(ALPHABETS))).cast("int")
    letters = F.element_at(F.array(*map(F.lit, ALPHABETS)), i + 1)
    length = F.lit(16) + F.pmod("key", F.lit(33)).cast("int")
    made = plain.select("key", "before", "after", "word", "candidate", letters.alias("letters"), length.alias("n"))
    made = made.withColumn("made", F.expr(
        "array_join(transform(sequence(1, n), i -> substring(letters, cast(1 + pmod(xxhash64(key, i), length(letters)) as int), 1)), '')"
    ))
    word = F.replace("word", F.col("candidate"), F.col("made"))
    return made.select("key", "before", "after", word.alias("word"), F.col("made").alias("candidate"))


def train(labelled: DataFrame, triples: DataFrame):
    """A forest, from at most ``TRAIN_ROWS`` findings of each label chosen by hash; nothing if a label is missing.

    Announced keys may all be of one kind and stand where no other key does, so a made-up key in the place of each
    plain finding trains along with them.
    """
    key = F.xxhash64("candidate", "before", "after")
    raw = ("word", "candidate", "before", "after")
    parts = [
        labelled.where(F.col("label") == label).select(*raw, *FEATURES, "label", key.alias("key")).orderBy("key", *FEATURES).limit(TRAIN_ROWS)
        for label in (0.0, 1.0)
    ]
    rows = materialize(parts[0].unionByName(parts[1]), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    planted = with_features(planted_keys(rows.where("label = 0")), triples).withColumn("label", F.lit(1.0))
    rows = rows.select("key", "label", *FEATURES).unionByName(planted.select("key", "label", *FEATURES))
    rows = materialize(rows.coalesce(1).sortWithinPartitions("key", "label", *FEATURES), "training")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", probabilityCol="probability", numTrees=TREES, maxDepth=DEPTH, seed=7
    )
    return forest.fit(_vectors(rows.coalesce(1)))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def scan(docs: DataFrame, keys: list[str] | None = None, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of ``docs``: ``keys``, ``place``, ``number``, ``candidate``, ``score`` and ``is_secret``.

    ``labelled`` has findings as :func:`labelled_findings` gives them, from which the forest learns; without it they
    come from these documents. If they lack a label, no finding is removed and the score is null. Null and empty texts
    have no findings, repeated rows have theirs again, an empty table has none; other columns are not read. The score
    judges the finding's own shape and surroundings; what is announced and assigned stays, whatever its shape.
    """
    keys = keys or ["doc_id"]
    triples = materialize(dictionary(docs, text), "dictionary")
    found = materialize(with_features(materialize(candidates(docs, keys, text), "candidates"), triples), "features")
    forest = train(labelled_findings(found) if labelled is None else labelled, triples)
    shown = [*keys, "place", "number", "candidate"]
    if forest is None:
        return found.select(*shown, F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_secret"))
    scored = forest.transform(_vectors(found)).withColumn("score", vector_to_array("probability")[1])
    kept = (F.col("score") >= 0.5) | (_announced() & (F.col("assigned") > 0))
    return scored.select(*shown, "score", kept.alias("is_secret"))
