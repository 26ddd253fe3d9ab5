"""Exact duplicates by skew-safe combining.

Copies are first merged inside each task, then inside salted digest groups, and the winners of the salts are
merged last. The whole text is a grouping key at each of these steps, so the digest only spreads the work and
its collisions join nothing. DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywick.llm.storage import free_names, own_columns

SALTS = 1024


def normal_text(text: Column) -> Column:
    """The text with A-Z (and no other letter) in lower case; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    by_letter = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(by_letter)


def duplicate_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest=F.xxhash64
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    * Texts are equal when identical after lower-casing A-Z; null equals the empty text.
    * Of equal texts the largest ``doc_id`` stays (``keep_id``). Null ids lose to any other; a group with null ids
      only has a null ``keep_id`` and keeps one row.
    * Repeated rows (equal id and text) each get a row, and one of them is ``kept``.
    * An empty table gives an empty result; other columns, whatever their names, are not read.

    The salt is the task that reads a row, so each task merges its own copies before anything moves, and a text with a
    third of all rows arrives as one row per task, spread over ``salts`` groups; ``digest`` only has to spread texts.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), normal_text(F.col(text)).alias("text")).select(
        "doc_id", "text", digest("text").alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    )
    salted = base.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size"))
    classes = (
        salted.groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("group_size"))
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # rows find their class by a 256-bit digest: a matter of addressing, contents were compared above
    rows = (
        base.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
        .groupBy("doc_id", "text_sha256")
        .agg(F.count("*").cast("int").alias("copies"))
    )
    return rows.join(classes, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.explode(F.expr("transform(sequence(1, copies), i -> i = 1 AND doc_id <=> keep_id)")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    Rows whose id and text repeat count as one document; which of them stays is settled by their other columns'
    hash, so it is the same row each time unless they are equal throughout.
    """
    names = free_names(docs, "sha", "id", "no_id", "place")
    sha, own_id, no_id, place = names
    groups = duplicate_groups(docs, text, doc_id, salts)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.col("text_sha256").alias(sha), F.coalesce("doc_id", F.lit(0)).alias(own_id), F.isnull("doc_id").alias(no_id)
    )
    marked = docs.withColumns(
        {
            sha: F.sha2(normal_text(docs[text]), 256),
            own_id: F.coalesce(docs[doc_id], F.lit(0)),
            no_id: F.isnull(docs[doc_id]),
        }
    )
    # the window has the keys of the join, so rows move once
    first = Window.partitionBy(sha, own_id, no_id).orderBy(F.xxhash64(*own_columns(docs)))
    stay = marked.join(gone, [sha, own_id, no_id], "left_anti").withColumn(place, F.row_number().over(first))
    return stay.where(F.col(place) == 1).select(*own_columns(docs))
