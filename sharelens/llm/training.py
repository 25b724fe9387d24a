"""Labelled rows that a classifier learns from: all of them, or a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

#: At most this many labelled rows train a model, taken in the order of a hash of doc_id.
MAX_LABELLED = 16_000


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose label may not be learned from; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labels_of(labels: DataFrame, label: str, worst: str) -> DataFrame:
    """(doc_id, y): the labels outside the held-out third, of several of a doc_id the `worst` ("min" or "max")."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    return ids.groupBy("doc_id").agg(getattr(F, worst)("y").alias("y"))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, worst: str, bound: int = MAX_LABELLED, words: int | None = None
) -> DataFrame:
    """(doc_id, y, text): up to `bound` labelled documents outside the held-out third, in the order of a hash.

    With `words`, the sample ends before the document with which it would have more words in all than that.

    A doc_id with several labels takes the `worst` one ("min" or "max"), one
    with several texts the smallest text; null labels, doc_ids and labels
    without a document teach nothing. The sample of ids is bounded, so it is
    broadcast to the scan of the texts.
    """
    ids = labels_of(labels, label, worst).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    ids = stage(ids, "labelled")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = stage(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "training")
    if words is None:
        return rows
    sizes = rows.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n"))  # `bound` rows of two numbers at most
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = sizes.withColumn("upto", upto).where(F.col("upto") <= words).select("doc_id")
    return rows.join(F.broadcast(within), "doc_id")
