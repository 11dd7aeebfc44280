"""Cells of a variant taxonomy: keys, statistics, variance splits, opportunities, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Thresholds of cell pricing (fixed values).
MIN_SOLD_FOR_SPLIT, CV_LIMIT, MIN_SIDE, MIN_REDUCTION, TOO_CHEAP = 6, 0.5, 3, 20.0, 0.15


def cell_key(cell: Column, condition: Column) -> Column:
    """Sorted k=v pairs joined by ' | ', the condition among them if there is one."""
    with_condition = F.map_concat(cell, F.when(condition.isNotNull(), F.create_map(F.lit("condition"), condition)).otherwise(F.create_map().cast("map<string,string>")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(with_condition)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " | ")


def cv(prices: Column) -> Column:
    """Population coefficient of variation, 0 of fewer than two prices or a zero mean (an aggregate)."""
    return F.when((F.count(prices) < 2) | (F.avg(prices) == 0), 0.0).otherwise(F.stddev_pop(prices) / F.avg(prices))


def cell_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Active and sold counts and medians, their spread, and the variation of sold prices."""
    active, sold = F.when(F.col("is_active"), F.col("price")), F.when(F.col("is_sold"), F.col("price"))
    return rows.groupBy(*by).agg(
        F.count(active).alias("n_active"),
        F.count(sold).alias("n_sold"),
        F.percentile(active, F.lit(0.5)).alias("median_active"),
        F.percentile(sold, F.lit(0.5)).alias("median_sold"),
        F.when(F.count(sold) >= 2, cv(sold)).alias("cv"),
    ).withColumn("spread", F.col("median_active") - F.col("median_sold"))


def _side_cv(n: Column, s: Column, q: Column) -> Column:
    mean = s / n
    return F.when(mean == 0, 0.0).otherwise(F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0))) / mean)


def best_splits(rows: DataFrame, by: list[str]) -> DataFrame:
    """For each widely priced cell, the title token that lowers the weighted variation most, ties by token."""
    p = F.col("price")
    sold = rows.where("is_sold")
    totals = sold.groupBy(*by).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")).where(F.col("n") >= MIN_SOLD_FOR_SPLIT)
    totals = totals.withColumn("cv0", _side_cv(F.col("n"), F.col("s"), F.col("q"))).where(F.col("cv0") >= CV_LIMIT)
    words = sold.join(totals.select(*by), by, "left_semi").select(*by, "price", F.explode(tokens(F.col("title"))).alias("token"))
    sides = words.groupBy(*by, "token").agg(F.count("*").alias("nw"), F.sum(p).alias("sw"), F.sum(p * p).alias("qw")).join(totals, by)
    rest = F.col("n") - F.col("nw")
    sides = sides.where((F.col("nw") >= MIN_SIDE) & (rest >= MIN_SIDE) & (F.col("nw") / F.col("n")).between(0.15, 0.85))
    split = (_side_cv(F.col("nw"), F.col("sw"), F.col("qw")) * F.col("nw") + _side_cv(rest, F.col("s") - F.col("sw"), F.col("q") - F.col("qw")) * rest) / F.col("n")
    scored = sides.withColumn("reduction", F.round((F.col("cv0") - split) / F.col("cv0") * 100, 6)).where(F.col("reduction") >= MIN_REDUCTION)
    return scored.groupBy(*by).agg(F.min_by(F.struct("token", "reduction"), F.struct(-F.col("reduction"), "token")).alias("b")).select(*by, "b.token", "b.reduction")


def split_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with `cell_key` extended by the split token where the title has it."""
    s = best_splits(rows, by).select(*by, "token")
    has = F.array_contains(tokens(F.col("title")), F.col("token"))
    return rows.join(s, by, "left").withColumn("cell_key", F.when(has, F.concat_ws(" | ", F.nullif(F.col("cell_key"), F.lit("")), F.concat(F.lit("_split="), F.col("token")))).otherwise(F.col("cell_key"))).drop("token")


def opportunities(rows: DataFrame, by: list[str], fee_percent: float = 13.25, min_comps: int = 3) -> DataFrame:
    """Active listings priced below their cell's sold median after the fee."""
    stats = cell_stats(rows, by).where((F.col("n_sold") >= min_comps) & (F.coalesce("cv", F.lit(0.0)) < CV_LIMIT) & F.col("median_sold").isNotNull())
    live = rows.where("is_active").join(stats.select(*by, "median_sold", "n_sold"), by)
    live = live.where(F.col("price") / F.nullif(F.col("median_sold"), F.lit(0.0)) >= TOO_CHEAP)
    profit = F.col("median_sold") - F.col("price") - F.col("median_sold") * fee_percent / 100
    return live.withColumn("profit", profit).where("profit > 0").withColumn("margin", F.col("profit") / F.nullif(F.col("price"), F.lit(0.0)) * 100)


def days_to_sell(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean of whole days from creation to sale, negatives dropped, rounded as banker's."""
    days = F.floor(F.timestamp_diff("SECOND", F.col("created"), F.col("ended")) / 86400)
    return rows.where("is_sold").withColumn("days", days).where("days >= 0").groupBy(*by).agg(F.bround(F.avg("days"), 0).cast("bigint").alias("days"))


def facets(assignments: DataFrame, axes: list[str], active: dict[str, str]) -> DataFrame:
    """Counts of every value of every axis under the filters on all other axes; one pass, zero counts kept."""
    others = {a: [F.col(x) == v for x, v in active.items() if x != a] for a in axes}
    passes = lambda a: F.lit(True) if not others[a] else reduce(lambda p, q: p & q, others[a])
    rows = assignments.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value"), F.coalesce(passes(a), F.lit(False)).alias("ok")) for a in axes))).alias("f"))
    return rows.where("f.value IS NOT NULL").groupBy("f.axis", "f.value").agg(F.count_if("f.ok").alias("n"))
