"""Bounded samples of labelled documents for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a model is fitted on at most (about: each row is drawn by a hash of its id).
SAMPLE_ROWS = 12_000
HELD_OUT = 2


def fold(doc_id: Column) -> Column:
    """0 to 3 by the CRC-32 of the id as text; a missing id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 4


def is_held_out(doc_id: Column) -> Column:
    return fold(doc_id) == HELD_OUT


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``text, label`` of at most about ``rows`` labelled documents outside the held-out fold.

    Each label is drawn with the probability that its share of all labels gives, by a hash of its
    id, so the draw is the same in every run and at every order of the rows. Ids labelled twice
    count as positive if one label is. The drawn labels, ``rows`` of them, are broadcast.
    """
    known = (
        labels.where(
            F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col("doc_id"))
        )
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    total = known.count()
    share = min(1.0, rows / total) if total else 0.0
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20))
    drawn = known.where(draw < int(share * (1 << 20))) if share < 1 else known
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")
