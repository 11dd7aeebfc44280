"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of `documents`; the last
returns the packed pieces. Each result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stallwright.llm import decontamination, near_dedup, packing, pii, toxicity
from stallwright.llm.common import bounded, fresh_dir, table


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.7 or more go.

    Null and empty texts score by the bias alone; without labels none goes; long texts are read whole; ties (a score of
    exactly 0.7) go; repeated rows share their fate; an empty table stays empty; extra columns come through.
    """
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id.

    Null texts are empty ones, and these one class; of rows that agree in doc_id and text one stays, any of them; rows
    with a null doc_id lose against those with one; long texts are read whole; an empty table stays empty; extra
    columns come through.
    """
    return near_dedup.deduplicated(docs)


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Null and empty texts stay; without items none goes; long texts are scanned whole; repeated rows share their fate; an
    empty table stays empty; extra columns come through.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@bounded
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; no document goes.

    Null stays null, empty stays empty; overlapping spans become one mark; n_chars follows where a text changed; long
    texts are read whole; repeated rows change alike; an empty table stays empty; other columns come through.
    """
    return pii.without_personal_data(docs)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences.

    Null and empty texts are the end-of-text id alone; only texts beyond 2048 ids are cut; ties of length are dealt by
    task and place; repeated rows are packed each; an empty table gives no pieces; extra columns are ignored.
    """
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack),
]
#: A learned classifier and MinHash candidates are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
