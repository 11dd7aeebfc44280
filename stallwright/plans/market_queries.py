"""Filters, paging, market statistics, runs and overview."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import market as K
from ..registry import query
from ..sources import mapping as M
from ..sources.mapping import AS_OF, rnd
from .pricing_queries import rounded

DAYS = f"date_diff('day', created, coalesce(ended, TIMESTAMP '{AS_OF}'))"


@query("src_table", "SELECT listing_id, round(price, 4) AS price, status FROM listings WHERE status IN ('Active', 'Sold') AND job_id = 3")
def src_table(spark, sf_dir):
    return rounded(M.listings(spark, sf_dir).where("status IN ('Active', 'Sold') AND job_id = 3").select("listing_id", "price", "status"))


@query("src_sql", "SELECT status, condition, count(*) AS n FROM listings GROUP BY 1, 2")
def src_sql(spark, sf_dir):
    return spark.sql("SELECT status, condition, count(*) AS n FROM {rows} GROUP BY 1, 2", rows=M.listings(spark, sf_dir))


@query("src_scalar", "SELECT count(*) AS n FROM listings WHERE price IS NULL")
def src_scalar(spark, sf_dir):
    return M.listings(spark, sf_dir).where("price IS NULL").agg(F.count("*").alias("n"))


@query("src_search_limit", "SELECT DISTINCT listing_id FROM listings WHERE status = 'Active' ORDER BY listing_id LIMIT 500")
def src_search_limit(spark, sf_dir):
    return M.listings(spark, sf_dir).where("status = 'Active'").select("listing_id").distinct().orderBy("listing_id").limit(500)


@query("src_search_sold", "SELECT DISTINCT listing_id, ended FROM listings WHERE status = 'Sold' AND ended BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-06-30'")
def src_search_sold(spark, sf_dir):
    return M.listings(spark, sf_dir).where("status = 'Sold' AND ended BETWEEN TIMESTAMP_NTZ '1999-01-01' AND TIMESTAMP_NTZ '1999-06-30'").select("listing_id", "ended").distinct()


@query("flt_listings", f"SELECT listing_id, title, round(price, 4) AS price FROM listings WHERE status = 'Sold' AND lower(title) LIKE '%red%' AND upper(condition) = 'NEW' AND price BETWEEN 100 AND 3000 AND {DAYS} BETWEEN 10 AND 900")
def flt_listings(spark, sf_dir):
    f = K.ListingFilter(status="Sold", title_like="Red", condition="new", price=(100, 3000), days=(10, 900))
    return rounded(K.filtered(M.listings(spark, sf_dir), f, M.as_of()).select("listing_id", "title", "price"))


@query("flt_days", f"SELECT listing_id, CAST({DAYS} AS BIGINT) AS days FROM listings WHERE {DAYS} <= 100")
def flt_days(spark, sf_dir):
    return rounded(K.filtered(M.listings(spark, sf_dir), K.ListingFilter(days=(None, 100)), M.as_of()).select("listing_id", K.days_on_market(M.as_of()).alias("days")))


@query("flt_axis", "SELECT listing_id, condition FROM (SELECT *, json_object('condition', condition, 'category', category)::VARCHAR AS cell FROM listings) WHERE json_extract_string(cell, '$.category') = 'SMALL'")
def flt_axis(spark, sf_dir):
    rows = M.listings(spark, sf_dir).withColumn("cell", F.to_json(F.struct("condition", "category")))
    return K.filtered(rows, K.ListingFilter(cell={"category": "SMALL"}), M.as_of()).select("listing_id", "condition")


@query("flt_regex", "SELECT listing_id, title FROM listings WHERE regexp_matches(title, '(?i)(small|blue) (ring|bolt)') ORDER BY title, listing_id LIMIT 40 OFFSET 40")
def flt_regex(spark, sf_dir):
    rows = K.filtered(M.listings(spark, sf_dir), K.ListingFilter(title_regex="(small|blue) (ring|bolt)"), M.as_of())
    return K.page(rows, {"title": F.col("title")}, "title", "title", False, 2, 40, "listing_id").select("listing_id", "title")


@query("flt_enabled", "SELECT job_id FROM jobs j WHERE is_enabled AND (NOT EXISTS (SELECT 1 FROM job_categories c WHERE c.job_id = j.job_id) OR EXISTS (SELECT 1 FROM job_categories c JOIN categories g ON g.category = c.category WHERE c.job_id = j.job_id AND g.is_enabled))")
def flt_enabled(spark, sf_dir):
    return K.effectively_enabled(M.jobs(spark, sf_dir), M.job_categories(spark, sf_dir), M.categories(spark, sf_dir)).select("job_id")


@query("flt_invalid", "SELECT listing_id, created FROM listings WHERE title IS NULL OR price IS NULL ORDER BY created DESC, listing_id LIMIT 100")
def flt_invalid(spark, sf_dir):
    return M.listings(spark, sf_dir).where("title IS NULL OR price IS NULL").orderBy(F.desc("created"), "listing_id").limit(100).select("listing_id", "created")


@query("flt_recent", "SELECT count(*) AS n FROM listings WHERE created > TIMESTAMP '2001-07-25 22:00:00'")
def flt_recent(spark, sf_dir):
    return M.listings(spark, sf_dir).where(F.col("created") > F.expr("TIMESTAMP_NTZ '2001-07-26' - INTERVAL 2 HOURS")).agg(F.count("*").alias("n"))


@query("flt_new_active", "SELECT listing_id FROM listings WHERE status = 'Active' AND job_id IN (1, 2) AND created >= (SELECT min(created) + INTERVAL 700 DAY FROM listings)")
def flt_new_active(spark, sf_dir):
    rows = M.listings(spark, sf_dir)
    start = rows.agg(F.expr("min(created) + INTERVAL 700 DAYS").alias("start"))
    return rows.where("status = 'Active' AND job_id IN (1, 2)").crossJoin(F.broadcast(start)).where("created >= start").select("listing_id")


_RANK = "CASE {0} WHEN 'Active' THEN 0 WHEN 'OutOfStock' THEN 1 WHEN 'Ended' THEN 2 WHEN 'Sold' THEN 3 ELSE -1 END"


@query(
    "flt_status_guard",
    f"""SELECT old, new, count(*) AS n FROM (SELECT lag(status) OVER (PARTITION BY listing ORDER BY recorded, history_id) AS old, status AS new FROM history)
    WHERE {_RANK.format("old")} < 0 OR {_RANK.format("new")} >= {_RANK.format("old")} GROUP BY 1, 2""",
)
def flt_status_guard(spark, sf_dir):
    old = F.lag("status").over(Window.partitionBy("listing").orderBy("recorded", "history_id"))
    rows = M.history(spark, sf_dir).select(old.alias("old"), F.col("status").alias("new"))
    return rows.where(K.can_update(F.col("old"), F.col("new"))).groupBy("old", "new").agg(F.count("*").alias("n"))


@query("flt_client", "SELECT job_id, search_term FROM jobs WHERE contains(lower(search_term), 'brand#1') AND job_id IN (SELECT job_id FROM job_categories WHERE category = 'SMALL')")
def flt_client(spark, sf_dir):
    groups = M.job_categories(spark, sf_dir).groupBy("job_id").agg(F.collect_set("category").alias("groups"))
    return M.jobs(spark, sf_dir).join(groups, "job_id").where(F.lower("search_term").contains("brand#1") & F.array_contains("groups", "SMALL")).select("job_id", "search_term")


@query("prj_ids", "SELECT item_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY k) AS ids FROM (SELECT item_id, k, TRY_CAST(trim(v) AS INTEGER) AS x FROM (SELECT item_id, unnest(string_split(s, ',')) AS v, generate_subscripts(string_split(s, ','), 1) AS k FROM (SELECT item_id, item_id || ', 2,x,' || (item_id * 3) || ', ' AS s FROM benchmark))) WHERE x IS NOT NULL GROUP BY 1")
def prj_ids(spark, sf_dir):
    s = F.concat(F.col("item_id"), F.lit(", 2,x,"), F.col("item_id") * 3, F.lit(", "))
    ids = F.filter(F.transform(F.split(s, ","), lambda v: F.trim(v).try_cast("int")), lambda v: v.isNotNull())
    return M.read(spark, sf_dir, "benchmark").select("item_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("srt_page_listings", f"SELECT listing_id, CAST({DAYS} AS BIGINT) AS days FROM listings WHERE job_id = 5 ORDER BY {DAYS} DESC, listing_id LIMIT 50 OFFSET 100")
def srt_page_listings(spark, sf_dir):
    keys = {"days": K.days_on_market(M.as_of()), "price": F.col("price")}
    return rounded(K.page(M.listings(spark, sf_dir).where("job_id = 5"), keys, "nonsense", "days", True, 3, 50, "listing_id").select("listing_id", keys["days"].alias("days")))


@query(
    "agg_market",
    f"""SELECT job_id, count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status IN ('Sold', 'Ended')) AS sold, round(avg(CASE WHEN status = 'Active' AND price > 0 THEN price END), 4) AS mean_ask,
    CAST(trunc(avg(CASE WHEN status IN ('Sold', 'Ended') THEN {DAYS} END)) AS BIGINT) AS days FROM listings WHERE job_id IN (SELECT job_id FROM jobs WHERE is_enabled) GROUP BY 1""",
)
def agg_market(spark, sf_dir):
    on = M.jobs(spark, sf_dir).where("is_enabled").select("job_id")
    return rounded(K.market_stats(M.listings(spark, sf_dir).join(on, "job_id", "left_semi"), M.as_of()).drop("q"))


@query("agg_market_pct", "SELECT job_id, round(quantile_cont(price, 0.25), 3) AS p25, round(quantile_cont(price, 0.5), 3) AS p50, round(quantile_cont(price, 0.75), 3) AS p75 FROM listings WHERE status IN ('Sold', 'Ended') AND price > 0 GROUP BY 1")
def agg_market_pct(spark, sf_dir):
    s = K.market_stats(M.listings(spark, sf_dir), M.as_of())
    return s.select("job_id", *(rnd(F.col("q")[k], 3).alias(n) for k, n in enumerate(("p25", "p50", "p75"))))


@query("agg_sell_through", "SELECT job_id, CAST(CASE WHEN a + s = 0 THEN 0 ELSE round_even(100.0 * s / (a + s), 0) END AS BIGINT) AS rate FROM (SELECT job_id, count(*) FILTER (status = 'Active') AS a, count(*) FILTER (status IN ('Sold', 'Ended')) AS s FROM listings GROUP BY 1)")
def agg_sell_through(spark, sf_dir):
    return K.market_stats(M.listings(spark, sf_dir), M.as_of()).select("job_id", K.sell_through(F.col("active"), F.col("sold")).alias("rate"))


@query("agg_sales_per_day", "SELECT job_id, round_even(count(*) / 180.0::DOUBLE, 1) AS per_day FROM listings WHERE status IN ('Sold', 'Ended') GROUP BY 1")
def agg_sales_per_day(spark, sf_dir):
    s = K.market_stats(M.listings(spark, sf_dir), M.as_of()).where("sold > 0")
    return s.select("job_id", K.sales_per_day(F.col("sold"), 180).alias("per_day"))


@query(
    "agg_filtered_stats",
    f"""SELECT count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status IN ('Sold', 'Ended')) AS sold, CAST(trunc(avg({DAYS})) AS BIGINT) AS days,
    round(avg(CASE WHEN price > 0 THEN price END), 4) AS mean, round(min(CASE WHEN price > 0 THEN price END), 4) AS low, round(max(price), 4) AS high FROM listings WHERE lower(title) LIKE '%blue%'""",
)
def agg_filtered_stats(spark, sf_dir):
    rows = K.filtered(M.listings(spark, sf_dir), K.ListingFilter(title_like="blue"), M.as_of())
    priced = F.when(F.col("price") > 0, F.col("price"))
    return rounded(rows.agg(F.count_if(F.col("status") == "Active").alias("active"), F.count_if(F.col("status").isin("Sold", "Ended")).alias("sold"), F.avg(K.days_on_market(M.as_of())).cast("int").alias("days"), F.avg(priced).alias("mean"), F.min(priced).alias("low"), F.max("price").alias("high")))


@query("agg_status_counts", "SELECT count(*) AS total, count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status = 'Sold') AS sold, count(*) FILTER (status IN ('Ended', 'OutOfStock')) AS ended FROM listings")
def agg_status_counts(spark, sf_dir):
    s = F.col("status")
    return M.listings(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(s == "Active").alias("active"), F.count_if(s == "Sold").alias("sold"), F.count_if(s.isin("Ended", "OutOfStock")).alias("ended"))


@query("agg_daily", "SELECT CAST(created AS DATE) AS day, count(*) AS n FROM listings GROUP BY 1")
def agg_daily(spark, sf_dir):
    return M.listings(spark, sf_dir).groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("n"))


@query("dt_bucket_day", "SELECT CAST(recorded AS DATE) AS day, status, count(*) AS n FROM history GROUP BY 1, 2")
def dt_bucket_day(spark, sf_dir):
    return M.history(spark, sf_dir).groupBy(F.to_date("recorded").alias("day"), "status").agg(F.count("*").alias("n"))


@query("win_running", "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT CAST(created AS DATE) AS day, count(*) AS n FROM listings GROUP BY 1)")
def win_running(spark, sf_dir):
    days = M.listings(spark, sf_dir).groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("total", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query("win_top_per_group", "SELECT job_id, listing_id FROM (SELECT job_id, listing_id, row_number() OVER (PARTITION BY job_id ORDER BY listing_id) AS k FROM listings WHERE status = 'Active') WHERE k <= 3")
def win_top_per_group(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("job_id").orderBy("listing_id"))
    return M.listings(spark, sf_dir).where("status = 'Active'").select("job_id", "listing_id", k.alias("k")).where("k <= 3").drop("k")


@query("win_latest", "SELECT job_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started DESC, run_id DESC) AS k FROM runs) WHERE k = 1")
def win_latest(spark, sf_dir):
    last = F.max_by(F.struct("run_id", "status"), F.struct("started", "run_id"))
    return M.runs(spark, sf_dir).groupBy("job_id").agg(last.alias("r")).select("job_id", "r.run_id", "r.status")


@query("win_dedupe", "SELECT part_id, min(listing_id) AS listing_id FROM listings GROUP BY 1")
def win_dedupe(spark, sf_dir):
    return M.listings(spark, sf_dir).groupBy("part_id").agg(F.min("listing_id").alias("listing_id"))


@query(
    "agg_batch",
    """SELECT batch_id, min(started) AS started, CASE WHEN bool_and(status = 'Completed') THEN max(completed) END AS completed, count(*) AS n, CAST(sum(added_active) AS BIGINT) AS active, CAST(sum(added_sold) AS BIGINT) AS sold,
    CAST(sum(failed_items) AS BIGINT) AS failed, count(*) FILTER (status = 'Completed') AS done FROM runs GROUP BY 1""",
)
def agg_batch(spark, sf_dir):
    done = F.col("status") == "Completed"
    return M.runs(spark, sf_dir).groupBy("batch_id").agg(F.min("started").alias("started"), F.when(F.bool_and(done), F.max("completed")).alias("completed"), F.count("*").alias("n"), F.sum("added_active").alias("active"), F.sum("added_sold").alias("sold"), F.sum("failed_items").alias("failed"), F.count_if(done).alias("done"))


@query(
    "agg_batch_status",
    """SELECT k, CASE WHEN bool_or(status = 'Running') THEN 'Running' WHEN bool_and(status = 'Queued') THEN 'Queued' WHEN bool_or(status = 'Queued') THEN 'Running' WHEN bool_and(status = 'Completed') THEN 'Completed'
    WHEN bool_and(status = 'Failed') THEN 'Failed' ELSE 'PartialFailure' END AS status FROM (SELECT run_id // 2 AS k, status FROM runs) GROUP BY k""",
)
def agg_batch_status(spark, sf_dir):
    return M.runs(spark, sf_dir).groupBy(F.expr("run_id div 2").alias("k")).agg(K.batch_status(F.col("status")).alias("status"))


@query("agg_issue_count", "SELECT r.run_id, count(i.issue_id) AS n FROM runs r LEFT JOIN issues i ON i.run_id = r.run_id GROUP BY 1")
def agg_issue_count(spark, sf_dir):
    counts = M.issues(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"))
    return M.runs(spark, sf_dir).select("run_id").join(counts, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_last_run", "SELECT job_id, max(started) AS last FROM runs GROUP BY 1")
def agg_last_run(spark, sf_dir):
    return M.runs(spark, sf_dir).groupBy("job_id").agg(F.max("started").alias("last"))


@query("agg_currency_quality", "SELECT currency, count(*) AS n, count(*) FILTER (price IS NULL) AS no_price, count(*) FILTER (title IS NULL) AS no_title FROM listings GROUP BY 1")
def agg_currency_quality(spark, sf_dir):
    return M.listings(spark, sf_dir).groupBy("currency").agg(F.count("*").alias("n"), F.count_if(F.col("price").isNull()).alias("no_price"), F.count_if(F.col("title").isNull()).alias("no_title"))


@query("agg_batch_summary", "SELECT count(*) AS runs, CAST(sum(added_active + added_sold) AS BIGINT) AS added, count(*) FILTER (status = 'Failed') AS failed FROM runs")
def agg_batch_summary(spark, sf_dir):
    return M.runs(spark, sf_dir).agg(F.count("*").alias("runs"), F.sum(F.col("added_active") + F.col("added_sold")).alias("added"), F.count_if(F.col("status") == "Failed").alias("failed"))


@query("agg_progress", "SELECT batch_id, done, total, total - done AS remaining, CAST(CASE WHEN total = 0 THEN 0 ELSE floor(100.0 * done / total) END AS BIGINT) AS percent, round(done / nullif(minutes, 0), 4) AS rate, round((total - done) / nullif(done / nullif(minutes, 0), 0), 4) AS eta FROM (SELECT batch_id, count(*) FILTER (status IN ('Completed', 'Failed')) AS done, count(*) AS total, date_diff('second', min(started), max(started)) / 60.0::DOUBLE AS minutes FROM runs GROUP BY 1)")
def agg_progress(spark, sf_dir):
    g = M.runs(spark, sf_dir).groupBy("batch_id").agg(F.count_if(F.col("status").isin("Completed", "Failed")).alias("done"), F.count("*").alias("total"), F.min("started").alias("a"), F.max("started").alias("b"))
    whole = lambda c: F.date_trunc("second", c)
    minutes = F.timestamp_diff("SECOND", whole("a"), whole("b")) / F.lit(60.0)
    rate = F.col("done") / F.nullif(minutes, F.lit(0.0))
    return g.select("batch_id", "done", "total", (F.col("total") - F.col("done")).alias("remaining"), F.floor(100 * F.col("done") / F.col("total")).alias("percent"), rnd(rate).alias("rate"), rnd((F.col("total") - F.col("done")) / F.nullif(rate, F.lit(0.0))).alias("eta"))


@query("agg_distinct", "SELECT DISTINCT condition FROM listings WHERE condition IS NOT NULL AND job_id = 4")
def agg_distinct(spark, sf_dir):
    return M.listings(spark, sf_dir).where("condition IS NOT NULL AND job_id = 4").select("condition").distinct().orderBy("condition")


@query("srt_history", "SELECT run_id, status FROM runs ORDER BY CASE status WHEN 'Running' THEN 0 WHEN 'Queued' THEN 1 ELSE 2 END, started DESC, run_id LIMIT 50")
def srt_history(spark, sf_dir):
    first = F.when(F.col("status") == "Running", 0).when(F.col("status") == "Queued", 1).otherwise(2)
    return M.runs(spark, sf_dir).orderBy(first, F.desc("started"), "run_id").limit(50).select("run_id", "status")


@query("srt_batches", "SELECT batch_id, max(started) AS last FROM runs GROUP BY 1 ORDER BY last DESC, batch_id LIMIT 20 OFFSET 20")
def srt_batches(spark, sf_dir):
    g = M.runs(spark, sf_dir).groupBy("batch_id").agg(F.max("started").alias("last"))
    return K.page(g, {"last": F.col("last")}, "last", "last", True, 2, 20, "batch_id")


@query("jn_semi_in", "SELECT listing_id FROM listings WHERE part_id IN (SELECT p_partkey FROM part WHERE p_size < 3)")
def jn_semi_in(spark, sf_dir):
    ids = M.read(spark, sf_dir, "part").where("p_size < 3").select(F.col("p_partkey").alias("part_id"))
    return M.listings(spark, sf_dir).join(ids, "part_id", "left_semi").select("listing_id")


@query("jn_hash_lookup", "SELECT l.listing_id, j.search_term FROM listings l JOIN jobs j ON j.job_id = l.job_id WHERE l.status = 'OutOfStock'")
def jn_hash_lookup(spark, sf_dir):
    return M.listings(spark, sf_dir).where("status = 'OutOfStock'").join(M.jobs(spark, sf_dir), "job_id").select("listing_id", "search_term")


@query("jn_count_nav", "SELECT g.category, count(c.job_id) AS n FROM categories g LEFT JOIN job_categories c ON c.category = g.category GROUP BY 1")
def jn_count_nav(spark, sf_dir):
    return M.categories(spark, sf_dir).join(M.job_categories(spark, sf_dir), "category", "left").groupBy("category").agg(F.count("job_id").alias("n"))


@query("arr_axes", "SELECT job_id, string_agg(category, '|' ORDER BY category) AS categories FROM job_categories GROUP BY 1")
def arr_axes(spark, sf_dir):
    return M.job_categories(spark, sf_dir).groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list("category")), "|").alias("categories"))


@query("dt_days_on_market", "SELECT listing_id, CAST(greatest(0, date_diff('day', created, coalesce(ended, TIMESTAMP '1999-01-01'))) AS BIGINT) AS days FROM listings")
def dt_days_on_market(spark, sf_dir):
    return rounded(M.listings(spark, sf_dir).select("listing_id", F.greatest(F.lit(0), F.datediff(F.coalesce("ended", F.lit("1999-01-01").cast("timestamp_ntz")), "created")).alias("days")))


@query("dt_lookback_pages", "SELECT DISTINCT d, CAST(CASE WHEN d IS NULL THEN 100 ELSE least(100, greatest(5, 2 * greatest(1, ceil(d) + 1))) END AS BIGINT) AS pages FROM (SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 80 / 2.0::DOUBLE END AS d FROM events)")
def dt_lookback_pages(spark, sf_dir):
    d = F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 80 / F.lit(2.0))
    pages = F.when(F.col("d").isNull(), 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(5), 2 * F.greatest(F.lit(1), F.ceil("d") + 1))))
    return M.read(spark, sf_dir, "events").select(d.alias("d")).distinct().select("d", pages.cast("bigint").alias("pages"))


@query("agg_ui_mean_median", "SELECT round(avg(m), 4) AS mean_median, round(max(v), 4) AS max_velocity FROM (SELECT job_id, quantile_cont(price, 0.5) FILTER (status IN ('Sold', 'Ended') AND price > 0) AS m, count(*) FILTER (status IN ('Sold', 'Ended')) / 180.0::DOUBLE AS v FROM listings GROUP BY 1) WHERE m > 0")
def agg_ui_mean_median(spark, sf_dir):
    s = K.market_stats(M.listings(spark, sf_dir), M.as_of()).where(F.col("q")[1] > 0)
    return rounded(s.agg(F.avg(F.col("q")[1]).alias("mean_median"), F.max(F.col("sold") / F.lit(180.0)).alias("max_velocity")))


@query("dt_next_2am", "SELECT run_id, date_trunc('day', started) + INTERVAL 2 HOUR + CASE WHEN started >= date_trunc('day', started) + INTERVAL 2 HOUR THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS next FROM runs")
def dt_next_2am(spark, sf_dir):
    two = F.to_date("started").cast("timestamp_ntz") + F.expr("INTERVAL 2 HOURS")
    return M.runs(spark, sf_dir).select("run_id", F.when(F.col("started") >= two, two + F.expr("INTERVAL 1 DAY")).otherwise(two).alias("next"))
