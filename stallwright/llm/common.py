"""What the training-data operators share: words, table access, the shared folder, clash-free columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that separate words become blanks, A-Z become a-z; every byte above 0x7F belongs to a word.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, lone surrogates (not valid in UTF-8) become '?'."""
    return (text or "").encode("utf-8", "replace")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters, as UTF-8."""
    return utf8(text).translate(WORD_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"file:///tmp/checkpoints/{os.getpid()}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that a checkpoint has replaced.

    They go when the driver's JVM collects their plans, which on a large heap can be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes that an Arrow batch between the JVM and Python may have; texts can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded(f: Callable) -> Callable:
    """The query or stage, with the session's Arrow batches bounded by `BATCH`."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        for key, most in BATCH.items():
            if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
                spark.conf.set(key, most)
        return f(spark, *args)

    return run


def give_back() -> None:
    """Returns the memory that this process has freed, but keeps for itself, to the system (where its C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, after which its worker gives memory back: workers stay for later tasks, beside the JVM."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash with one an operator adds."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def text_digest(text: str = "text") -> Column:
    """MD5 of the text, that of the empty one for null."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


#: Rows of one key that stay together where `joined` splits a key, and keys that it splits up to which they are broadcast.
TOGETHER, FEW_HOT = 250, 100_000


def joined(rows: DataFrame, key: str, by: str, side: DataFrame, side_key: str, how: str = "inner", also: Column | None = None, first: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """`rows` joined with the row of `side` that has their key; a key with many rows is dealt over tasks by the hash of `by`.

    A key of n rows, more than `TOGETHER`, gets n / TOGETHER parts; the side's row of that key is repeated for each, so
    at most one repeat comes on TOGETHER rows. `first` is applied to the rows before they meet the side. `rows` are read
    several times; names must differ from those of the side.
    """
    on = F.col(key) == F.col(side_key)
    on = on if also is None else on & also
    hot = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_hot").isNotNull() & (F.col("_n") > TOGETHER))
    hot = cut(hot.select("_hot", F.ceil(F.col("_n") / TOGETHER).alias("_parts")))
    n = hot.count()
    if not n:
        return first(rows).join(side, on, how)
    hot = F.broadcast(hot) if n <= FEW_HOT else hot
    cold = first(rows.join(hot, F.col(key) == F.col("_hot"), "left_anti")).join(side, on, how)
    dealt = rows.join(hot, F.col(key) == F.col("_hot")).withColumn("_part", F.pmod(F.xxhash64(by), "_parts")).drop("_hot", "_parts")
    copies = side.join(hot, F.col(side_key) == F.col("_hot")).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_hot", "_parts")
    return cold.unionByName(first(dealt).join(copies, on & (F.col("_part") == F.col("_copy")), how).drop("_part", "_copy"))


def fresh_names(docs: DataFrame, n: int) -> list[str]:
    """n column names that the frame doesn't have."""
    have = {c.lower() for c in docs.columns}
    return list(itertools.islice((c for c in (f"_x{k}" for k in itertools.count()) if c not in have), n))


def kept_rows(docs: DataFrame, make: Callable[[], Callable[[str | None], bool]], text: str = "text") -> DataFrame:
    """The rows whose text passes the test that `make` builds once for each task; all columns stay as they are."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for b in batches:
            yield b.filter(pa.array([test(t.as_py()) for t in b.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
