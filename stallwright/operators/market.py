"""Market listings: conjunctive filters, paging, and market statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("Active", "Sold", "Ended", "OutOfStock")
#: Rank of a status; a change may not lower it (fixed values).
STATUS_RANK = {"Active": 0, "OutOfStock": 1, "Ended": 2, "Sold": 3}


@dataclass(frozen=True)
class ListingFilter:
    """Conditions that are None are left out of the plan."""

    job_id: int | None = None
    status: str | None = None
    title_like: str | None = None
    title_regex: str | None = None
    condition: str | None = None
    price: tuple[float | None, float | None] = (None, None)
    days: tuple[int | None, int | None] = (None, None)
    cell: dict[str, str] = field(default_factory=dict)


def days_on_market(as_of: Column) -> Column:
    """Midnights between creation and the end, or now."""
    return F.datediff(F.coalesce(F.col("ended"), as_of), F.col("created"))


def filtered(rows: DataFrame, f: ListingFilter, as_of: Column) -> DataFrame:
    """All given conditions; an unknown status is ignored; the regex ignores case and drops null titles."""
    tests: list[Column] = []
    if f.job_id is not None:
        tests.append(F.col("job_id") == f.job_id)
    if f.status in STATUSES:
        tests.append(F.col("status") == f.status)
    if f.title_like:
        tests.append(F.lower("title").like(f"%{f.title_like.lower()}%"))
    if f.title_regex:
        tests.append(F.col("title").rlike(f"(?i){f.title_regex}"))
    if f.condition:
        tests.append(F.upper("condition") == f.condition.upper())
    for (lo, hi), c in ((f.price, F.col("price")), (f.days, days_on_market(as_of))):
        tests += [c >= lo] * (lo is not None) + [c <= hi] * (hi is not None)
    tests += [F.get_json_object("cell", f"$['{axis}']") == value for axis, value in f.cell.items()]
    for t in tests:
        rows = rows.where(t)
    return rows


def page(rows: DataFrame, keys: dict[str, Column], sort_by: str, default: str, descending: bool, number: int, size: int, tie: str, nulls_last: bool = False) -> DataFrame:
    """A page of the rows; unknown keys sort by the default, pages start at 1, sizes are 1 to 200, ties by id."""
    key = keys.get(sort_by, keys[default])
    order = (key.desc_nulls_last() if descending else key.asc_nulls_last()) if nulls_last else (key.desc() if descending else key.asc())
    size = min(200, max(1, size))
    return rows.orderBy(order, tie).offset((max(1, number) - 1) * size).limit(size)


def sell_through(active: Column, sold: Column) -> Column:
    """Percent sold, rounded as banker's; 0 of nothing."""
    return F.when(active + sold == 0, F.lit(0)).otherwise(F.bround(100 * sold / F.nullif(active + sold, F.lit(0)), 0)).cast("bigint")


def sales_per_day(sold: Column, lookback: int) -> Column:
    return F.bround(sold / F.lit(float(lookback)), 1) if lookback > 0 else F.lit(0.0)


def market_stats(rows: DataFrame, as_of: Column, sold_statuses: tuple[str, ...] = ("Sold", "Ended")) -> DataFrame:
    """Per job: active and sold counts, mean ask, whole mean days, quartiles of sold prices; one shuffle."""
    sold, priced = F.col("status").isin(*sold_statuses), F.col("price") > 0
    q = F.percentile(F.when(sold & priced, F.col("price")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("job_id").agg(
        F.count_if(F.col("status") == "Active").alias("active"),
        F.count_if(sold).alias("sold"),
        F.avg(F.when((F.col("status") == "Active") & priced, F.col("price"))).alias("mean_ask"),
        F.avg(F.when(sold, days_on_market(as_of))).cast("int").alias("days"),
        q.alias("q"),
    )


def can_update(old: Column, new: Column) -> Column:
    """Whether a status may replace another: not to a lower rank, unless the old one is unknown."""
    rank = lambda c: F.coalesce(F.create_map(*(x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))))[c], F.lit(-1))
    return (rank(old) < 0) | (rank(new) >= rank(old))


def effectively_enabled(jobs: DataFrame, job_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """Enabled jobs that have no category or at least one enabled."""
    links = job_categories.join(categories.withColumnRenamed("is_enabled", "category_enabled"), "category")
    any_on = links.groupBy("job_id").agg(F.bool_or("category_enabled").alias("any_on"))
    return jobs.where("is_enabled").join(any_on, "job_id", "left").where(F.coalesce("any_on", F.lit(True))).drop("any_on")


def batch_status(status: Column) -> Column:
    """Status of a batch from those of its runs (an aggregate); no runs count as queued."""
    every = lambda s: F.coalesce(F.bool_and(status == s), F.lit(True))
    some = lambda s: F.coalesce(F.bool_or(status == s), F.lit(False))
    return F.when(some("Running"), "Running").when(every("Queued"), "Queued").when(some("Queued"), "Running").when(every("Completed"), "Completed").when(every("Failed"), "Failed").otherwise("PartialFailure")
