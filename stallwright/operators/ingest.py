"""Ingest: classification of scraped summaries, upserts, histories, result tables, an embeddings index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .market import can_update


def sold_wins(active: DataFrame, sold: DataFrame) -> DataFrame:
    """The two lists together, the sold entry of a listing before the active one."""
    both = sold.withColumn("_sold", F.lit(True)).unionByName(active.withColumn("_sold", F.lit(False)))
    k = F.row_number().over(Window.partitionBy("listing_id").orderBy(F.desc("_sold"), "price"))
    return both.withColumn("_k", k).where("_k = 1").drop("_k", "_sold")


def classified(summaries: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds `kind`: new, cross_job, terminal, sold or update; existing has listing_id, job_id and status."""
    old = existing.select("listing_id", F.col("job_id").alias("old_job"), F.col("status").alias("old_status"))
    kind = (
        F.when(F.col("old_status").isNull(), "new")
        .when(F.col("old_job") != F.col("job_id"), "cross_job")
        .when(F.col("old_status").isin("Sold", "Ended"), "terminal")
        .when(F.col("status") == "Sold", "sold")
        .otherwise("update")
    )
    return summaries.join(old, "listing_id", "left").withColumn("kind", kind)


def upsert(target: DataFrame, rows: DataFrame, key: str = "listing_id") -> DataFrame:
    """Target with rows merged in: new keys are added, known ones updated where the status may change."""
    new = rows.select(key, *(F.col(c).alias(f"_{c}") for c in target.columns if c != key), F.lit(True).alias("_new"))
    old = target.withColumn("_old", F.lit(True))
    take = F.col("_old").isNull() | (F.col("_new") & can_update(F.col("status"), F.col("_status")))
    return old.join(new, key, "full").select(key, *(F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns if c != key))


def update_batch(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Target with the column replaced where updates has the key."""
    return target.join(updates.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def changes(history: DataFrame, column: str) -> DataFrame:
    """Entries where the column differs from the listing's entry before; the first entry is initial."""
    w = Window.partitionBy("listing").orderBy("recorded", "history_id")
    before = F.lag(column).over(w)
    rows = history.withColumn("before", before).withColumn("initial", F.row_number().over(w) == 1)
    return rows.where(F.col("initial") | ~F.col("before").eqNullSafe(F.col(column)))


def description_status(fetched: Column, text: Column) -> Column:
    return F.when(~F.coalesce(fetched, F.lit(False)), "failed").when(text.isNull(), "missing").otherwise("complete")


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Full replace: written beside the old table, then renamed into its place; a failed write leaves the old table.

    `df` may read the old table. Between the two renames no table is at the path; the old one is then at path + ".old".
    """
    spark, new, old = df.sparkSession, f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(new), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"cannot move {new}")
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def replace_keys(df: DataFrame, path: str, key: str) -> DataFrame:
    """Replaces the partitions of the keys in df and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with doubled quotes and line breaks in fields; nan is null."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "nan").csv(path)


def write_jsonl(df: DataFrame, path: str, per_file: int = 50_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", per_file).json(path)


BATCH_LINE = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>, error struct<message:string>"


def batch_output(lines: DataFrame) -> DataFrame:
    """(id, index, verdict, reason, error) of batch-API output lines in `value`."""
    r = lines.select(F.from_json("value", BATCH_LINE).alias("r")).select("r.*")
    answer = F.from_json(F.try_element_at(F.col("response.body.choices"), F.lit(1))["message"]["content"], "verdict string, reason string")
    return r.select(F.col("custom_id").alias("id"), F.regexp_extract("custom_id", r"(\d+)$", 1).try_cast("bigint").alias("index"), answer["verdict"].alias("verdict"), answer["reason"].alias("reason"), F.col("error.message").alias("error"))


class Index:
    """Vectors by id as a Parquet table: upsert, remove, contains.

    Upsert replaces known ids and keeps one row of each new id: of repeated ones the one with the largest vector.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def upsert(self, rows: DataFrame) -> Index:
        once = rows.groupBy("id").agg(F.max(F.struct(*(c for c in rows.columns if c != "id"))).alias("_r")).select("id", "_r.*")
        return Index(self.rows.join(once, "id", "left_anti").unionByName(once))

    def remove(self, ids: DataFrame) -> Index:
        return Index(self.rows.join(ids, "id", "left_anti"))

    def contains(self, ids: DataFrame) -> DataFrame:
        known = self.rows.select("id").withColumn("found", F.lit(True))
        return ids.join(known, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(path))
