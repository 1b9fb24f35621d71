"""Bounded labelled samples for fitting, and the fold that is never fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold kept from fitting: crc32 of the id as text, modulo 5, is 0.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` of each labelled id outside the held-out fold; an id with several labels has their maximum."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
            .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")))


def label_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """How many ids have each label, over all labelled ids outside the held-out fold."""
    return {r.label: r.n for r in known_labels(labels, label).groupBy("label").agg(F.count("*").alias("n")).collect()}


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id, label`` of at most ``per_class`` ids of each label outside the held-out fold, of those that ``docs`` has.

    Ids are taken in the order of a hash, so reruns agree.  An id with several labels has their maximum; null labels and
    ids are left out.
    """
    known = known_labels(labels, label).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = [known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for value in (0, 1)]
    return parts[0].union(parts[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, columns: list[str]) -> list:
    """At most ``per_class`` rows of each label outside the held-out fold, of ``max_chars`` characters in all per label.

    Rows are taken in the order of a hash of their id; one longer than what is left of the characters is passed over.
    The chosen ids are a few thousand at most, so the join may be broadcast.
    """
    chosen = labelled_ids(docs, labels, label, per_class)
    rows = docs.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id")
    sizes = (rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("text").alias("h"))).alias("m"))
             .select("doc_id", "label", "m.n", "m.h").orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    left, taken = {0: max_chars, 1: max_chars}, []
    for r in sizes:
        if r.n <= left[r.label]:
            left[r.label] -= r.n
            taken.append((r.doc_id, r.h))
    ids = docs.sparkSession.createDataFrame(taken, "doc_id long, h long")
    held = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "h"]).dropDuplicates(["doc_id"])
    return held.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", *columns, "label").collect()
