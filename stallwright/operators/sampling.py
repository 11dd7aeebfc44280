"""Samples: by hash, evenly spaced, by price, in bands, stratified splits. None depends on a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def draw(*cols: str, seed: int = SEED) -> Column:
    return F.xxhash64(*cols, F.lit(seed))


def random_rows(rows: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    return rows.orderBy(draw(key, seed=seed), key).limit(n)


def per_group(rows: DataFrame, by: list[str], key: str, n: int, seed: int = SEED) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*by).orderBy(draw(key, seed=seed), key))
    return rows.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def evenly(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Rows int(i * N / n) of each group in order, all of a group of at most n."""
    w = Window.partitionBy(*by)
    at = F.row_number().over(w.orderBy(order)) - 1
    total = F.count("*").over(w)
    exact = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_n") / n) == F.col("_at"))
    return rows.withColumn("_at", at).withColumn("_n", total).where((F.col("_n") <= n) | exact).drop("_at", "_n")


def by_price(rows: DataFrame, by: list[str], n: int, key: str = "listing_id") -> DataFrame:
    """Rows int(i * (N - 1) / (n - 1)) of each group in order of price."""
    w = Window.partitionBy(*by)
    at, total = F.row_number().over(w.orderBy("price", key)) - 1, F.count("*").over(w)
    hit = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (n - 1)) == F.col("_at"))
    return rows.withColumn("_at", at).withColumn("_n", total).where(hit).drop("_at", "_n")


def split(rows: DataFrame, strata: list[str], key: str, shares: dict[str, float], pool_below: int = 10, seed: int = SEED) -> DataFrame:
    """Adds `part`; strata with fewer rows than `pool_below` are pooled by their last column."""
    small = F.count("*").over(Window.partitionBy(*strata)) < pool_below
    stratum = F.when(small, F.concat(F.lit("pooled|"), F.col(strata[-1]).cast("string"))).otherwise(F.concat_ws("|", *(F.col(c).cast("string") for c in strata)))
    w = Window.partitionBy("_s")
    rows = rows.withColumn("_s", stratum).withColumn("_r", (F.row_number().over(w.orderBy(draw(key, seed=seed), key)) - F.lit(0.5)) / F.count("*").over(w))
    part, top = F.when(F.lit(False), ""), 0.0
    for name, share in shares.items():
        top += share
        part = part.when(F.col("_r") <= top, name)
    return rows.withColumn("part", part.otherwise(name)).drop("_s", "_r")
