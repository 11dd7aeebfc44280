"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import saved


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node on a link (a, b); links to itself count.

    Large-star and small-star steps take turns: each node hands its larger neighbours, then its smaller ones, the
    smallest node it knows, until no link changes; their number grows with the logarithm of the longest path.
    """
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        moved = larger.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return alone.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        before = now
    raise RuntimeError("components did not settle")
