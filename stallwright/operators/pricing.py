"""Pricing from comparables: directed edges, outlier rule, weighted mean, median, confidence and profit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PricingOptions:
    """Defaults of the pricing formulas (fixed values)."""

    iqr_multiplier: float = 1.5
    weight_power: float = 2.0
    decay_days: float = 30.0
    sample_target: float = 20.0
    sample_weight: float = 0.3
    trust_weight: float = 0.4
    spread_weight: float = 0.3
    fee_percent: float = 13.25
    min_comps: int = 3
    price_band: float | None = None
    match_condition: bool = False


DEFAULTS = PricingOptions()


def directed_comps(edges: DataFrame, listings: DataFrame) -> DataFrame:
    """(active, sold) pairs of comparable edges, whichever way round an edge is stored.

    The edge is opened into its two directions by one scan, so listings are joined once on each end; the active end
    comes last, so the rows are dealt by it for what follows.
    """
    ends = F.explode(F.array(F.struct(F.col("id_a").alias("x"), F.col("id_b").alias("y")), F.struct(F.col("id_b").alias("x"), F.col("id_a").alias("y"))))
    both = edges.where("is_comparable").select(ends.alias("e"), "similarity", "confidence").select("e.x", "e.y", "similarity", "confidence")
    a = listings.where("status = 'Active'").select(F.col("listing_id").alias("x"), F.col("price").alias("ask"), "shipping", F.col("condition").alias("a_condition"), "job_id")
    s = listings.where("status = 'Sold'").select(F.col("listing_id").alias("y"), F.col("price").alias("sold_price"), F.col("condition").alias("s_condition"), "created", "ended")
    return both.join(s, "y").join(a, "x").withColumnsRenamed({"x": "active_id", "y": "sold_id"})


def quartiles(comps: DataFrame) -> DataFrame:
    """Adds q1, q3 and n over the positive sold prices of each active listing; grouped and joined back, not windowed."""
    rows = comps.where("sold_price > 0")
    stats = rows.groupBy("active_id").agg(F.percentile("sold_price", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    return rows.join(stats.select("active_id", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "n"), "active_id")


def without_outliers(with_quartiles: DataFrame, multiplier: float = DEFAULTS.iqr_multiplier) -> DataFrame:
    """Keeps all of fewer than four prices or of zero spread, else those within the fences, both inclusive."""
    reach = multiplier * (F.col("q3") - F.col("q1"))
    inside = F.col("sold_price").between(F.col("q1") - reach, F.col("q3") + reach)
    return with_quartiles.where((F.col("n") < 4) | (F.col("q1") == F.col("q3")) | inside)


def weight(o: PricingOptions, as_of: Column) -> Column:
    days = F.datediff(as_of, F.col("ended"))
    return F.pow(F.coalesce("confidence", "similarity"), F.lit(o.weight_power)) * F.when(F.col("ended").isNull(), 1.0).otherwise(F.exp(-days / F.lit(o.decay_days)))


def profit(mean: Column, ask: Column, shipping: Column, fee_percent: float) -> Column:
    """With a fee, the fee and shipping are deducted from the mean in cents; without one, shipping is ignored."""
    cents = mean.cast("decimal(18,2)").cast("double")
    return cents * (1 - fee_percent / 100) - ask - F.coalesce(shipping, F.lit(0.0)) if fee_percent > 0 else cents - ask


def confidence(o: PricingOptions, price: str = "sold_price") -> Column:
    mean, sd, n = F.avg(price), F.stddev_samp(price), F.count(price)
    spread = F.when(n == 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - sd / F.nullif(mean, F.lit(0.0))))
    return o.sample_weight * (1 - F.exp(-n / F.lit(o.sample_target))) + o.trust_weight * F.avg(F.coalesce("confidence", "similarity")) + o.spread_weight * spread


def with_fences(comps: DataFrame) -> DataFrame:
    """As `quartiles`, by a window: the comparables of a listing, which its edges bound, are in one partition already."""
    w = Window.partitionBy("active_id")
    rows = comps.where("sold_price > 0")
    return rows.withColumn("q", F.percentile("sold_price", F.array(F.lit(0.25), F.lit(0.75))).over(w)).withColumn("n", F.count("*").over(w)).withColumns({"q1": F.col("q")[0], "q3": F.col("q")[1]}).drop("q")


def predictions(comps: DataFrame, as_of: Column, o: PricingOptions = DEFAULTS) -> DataFrame:
    """One row for each active listing with enough comparables and a positive profit.

    The comparables are dealt by listing once: quartiles, outliers, median and means all come from that one partitioning.
    The median is that of all prices within the fences, the rest of those in the price band, if there is one.
    """
    if o.match_condition:
        comps = comps.where("a_condition = s_condition")
    cleaned = without_outliers(with_fences(comps), o.iqr_multiplier)
    inside = (F.col("ask") > 0) & F.col("sold_price").between(F.col("ask") / o.price_band, F.col("ask") * o.price_band) if o.price_band else F.lit(True)
    rows = cleaned.withColumn("w", weight(o, as_of)).withColumn("in_band", inside)
    if o.price_band:
        rows = rows.withColumns({c: F.when(F.col("in_band"), F.col(c)) for c in ("w", "ended", "confidence", "similarity")}).withColumn("price", F.when(F.col("in_band"), F.col("sold_price")))
    else:
        rows = rows.withColumn("price", F.col("sold_price"))
    found = rows.groupBy("active_id").agg(
        F.count("price").alias("n"),
        (F.sum(F.col("price") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean_price"),
        F.first("ask").alias("ask"),
        F.first("shipping").alias("shipping"),
        F.first("job_id").alias("job_id"),
        F.avg(F.datediff("ended", "created")).cast("int").cast("bigint").alias("days_to_sell"),
        confidence(o, "price").alias("confidence"),
        (F.first("n") - F.count("price")).alias("outliers_removed"),
        F.percentile("sold_price", F.lit(0.5)).alias("median_price"),
    )
    found = found.withColumn("profit", profit(F.col("mean_price"), F.col("ask"), F.col("shipping"), o.fee_percent))
    return found.where((F.col("n") >= o.min_comps) & (F.col("profit") > 0))


def interpolated(sorted_prices: Column, p: float) -> Column:
    """Linear interpolation at p of a sorted array."""
    at = (F.size(sorted_prices) - 1) * F.lit(p)
    lo = F.floor(at).cast("int")
    return F.element_at(sorted_prices, lo + 1) + (at - lo) * (F.element_at(sorted_prices, F.least(lo + 2, F.size(sorted_prices))) - F.element_at(sorted_prices, lo + 1))


def analysis(rows: DataFrame, key: str, as_of: Column, o: PricingOptions = DEFAULTS) -> DataFrame:
    """Price analysis of (key, price, confidence, sold_date): rounded as banker's, money to 2 and ratios to 4 digits."""
    p = F.col("price")
    q = rows.groupBy(key).agg(F.percentile("price", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n_all"))
    reach = o.iqr_multiplier * (F.col("q")[1] - F.col("q")[0])
    clean = rows.join(q, key).where((F.col("n_all") < 4) | (reach == 0) | p.between(F.col("q")[0] - reach, F.col("q")[1] + reach))
    days = F.timestamp_diff("SECOND", F.col("sold_date"), as_of) / F.lit(86400.0)
    recent = F.when(F.col("sold_date").isNotNull(), F.exp(-days / F.lit(o.decay_days)))
    out = clean.groupBy(key).agg(
        F.count("*").alias("n"),
        (F.first("n_all") - F.count("*")).alias("removed"),
        F.avg("price").alias("mean"),
        F.percentile("price", F.lit(0.5)).alias("median"),
        (F.sum(p * F.col("confidence")) / F.nullif(F.sum("confidence"), F.lit(0.0))).alias("weighted"),
        (F.sum(p * recent) / F.nullif(F.sum(recent), F.lit(0.0))).alias("recency"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("sd"),
        F.avg("confidence").alias("trust"),
    )
    cv = F.when(F.col("mean") <= 0, 1.0).otherwise(F.col("sd") / F.col("mean"))
    score = o.sample_weight * (1 - F.exp(-F.col("n") / F.lit(o.sample_target))) + o.trust_weight * F.col("trust") + o.spread_weight * F.greatest(F.lit(0.0), 1 - cv)
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def latest_sold_price(history: DataFrame) -> DataFrame:
    """Price of the last Sold entry of each listing that has one; ties by history_id."""
    return history.where("status = 'Sold'").groupBy("listing").agg(F.max_by("price", F.struct("recorded", "history_id")).alias("sold_price"))


def comps_of(edges: DataFrame, listings: DataFrame, one: DataFrame, o: PricingOptions = DEFAULTS) -> DataFrame:
    """Sold listings at the other end of the edges of one listing (a frame of one row or none), by condition and price band.

    The listing meets the edges as a frame, nothing is fetched while the plan is built.
    """
    mine = F.broadcast(one.select(F.col("listing_id").alias("_id"), F.col("condition").alias("_condition"), F.col("price").alias("_ask")))
    edge = edges.where("is_comparable").join(mine, (F.col("id_a") == F.col("_id")) | (F.col("id_b") == F.col("_id")))
    other = F.when(F.col("id_a") == F.col("_id"), F.col("id_b")).otherwise(F.col("id_a"))
    rows = edge.select(other.alias("listing_id"), "similarity", "_condition", "_ask").join(listings.where("status = 'Sold' AND price > 0"), "listing_id")
    if o.match_condition:
        rows = rows.where("condition = _condition")
    if o.price_band:
        rows = rows.where((F.col("_ask") > 0) & F.col("price").between(F.col("_ask") / o.price_band, F.col("_ask") * o.price_band))
    return rows.drop("_condition", "_ask")


def running_total(rows: DataFrame, order: str, value: str) -> Column:
    return F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
