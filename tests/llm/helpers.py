"""Small frames for the operators' tests: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{k}" for k in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, texts: dict, extra: dict | None = None):
    """A frame of doc_id -> text; `extra` names further columns that hold the given constant."""
    from pyspark.sql import functions as F

    rows = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in texts.items()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({n: F.lit(v) for n, v in (extra or {}).items()})
