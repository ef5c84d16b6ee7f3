"""Labelled training rows, shared by the text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label tables up to this many rows (16 bytes each) are sent to every task; larger ones are joined by key.
SEND_AT_MOST = 1_000_000


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of the rows that no model learns from; rows without a key are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, text, n_chars, label) of documents outside the held-out fifth that have a 0/1 label.

    Of several labels of a document the highest counts; null texts are empty.
    """
    known = labels.where(F.col(column).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    few = labels.count() <= SEND_AT_MOST
    extra = F.col("n_chars").try_cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    texts = docs.where(~held_out()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), extra.alias("n_chars"))
    return texts.join(F.broadcast(known) if few else known, "doc_id")


def bounded_sample(rows: DataFrame, most: int, total: int) -> DataFrame:
    """About ``most`` rows, by a hash of the key: the documented bound of what a classifier is fitted on."""
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * most / total))
