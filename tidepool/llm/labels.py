"""Labelled rows for the trained operators: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learned from: crc32 of the id as text
    is divisible by 5 (false for null ids, which have no labels)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` of all labelled ids outside the held-out fold. Null
    ids and labels are left out; an id with several labels takes the
    smallest."""
    return (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()
                         & ~held_out(doc_id))
            .groupBy(F.col(doc_id).cast("bigint").alias("doc_id"))
            .agg(F.min(label).cast("int").alias("label")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, label)`` of about ``max_rows`` labelled rows at most,
    chosen by a hash of the id, without the held-out fold.

    The share is ``max_rows`` over the number of labelled ids, so the ids are
    few enough to broadcast (see :func:`known_labels`)."""
    known = known_labels(labels, label, doc_id)
    scale = 1 << 40
    share = min(scale, scale * max_rows // max(1, labels.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.lit(share))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
