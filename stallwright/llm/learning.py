"""What the two classifiers share: the bounded training sample and the fold of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1_000_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int, max_bytes: int, seed: int) -> DataFrame:
    """doc_id, text and y of the labelled rows outside the held-out fold, about `max_rows` and `max_bytes` at most.

    Labels without an id or a value teach nothing; a document with several labels gets the largest. When there are
    more rows or bytes of text than that, a hash of the id picks the sample, so it is the same for the same rows.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, size = texts.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id").agg(F.count("*"), F.sum("size")).first()
    share = min(1.0, max_rows / max(1, n), max_bytes / max(1, size or 0))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(PARTS)) < int(PARTS * share))
    return texts.join(known, "doc_id")
