"""Cells: statistics, splits, opportunities, facets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import market as K
from ..registry import query
from ..sources import mapping as M
from ..sources.mapping import rnd
from .pricing_queries import rounded

BY = ["job_id", "cell_key"]


@query("cell_key", "SELECT listing_id, cell_key FROM cells")
def cell_key(spark, sf_dir):
    return M.cells(spark, sf_dir).select("listing_id", "cell_key")


_STATS = """SELECT job_id, cell_key, count(*) FILTER (is_active) AS n_active, count(*) FILTER (is_sold) AS n_sold, quantile_cont(price, 0.5) FILTER (is_active) AS median_active, quantile_cont(price, 0.5) FILTER (is_sold) AS median_sold,
CASE WHEN count(*) FILTER (is_sold) >= 2 THEN CASE WHEN avg(price) FILTER (is_sold) = 0 THEN 0 ELSE stddev_pop(price) FILTER (is_sold) / avg(price) FILTER (is_sold) END END AS cv FROM {0} GROUP BY 1, 2"""


@query("agg_cell", f"SELECT job_id, cell_key, n_active, n_sold, round(median_active, 3) AS median_active, round(median_sold, 3) AS median_sold, round(cv, 4) AS cv, round(median_active - median_sold, 3) AS spread FROM ({_STATS.format('cells')})")
def agg_cell(spark, sf_dir):
    s = C.cell_stats(M.cells(spark, sf_dir), BY)
    return s.withColumns({c: rnd(c, 3) for c in ("median_active", "median_sold", "spread")} | {"cv": rnd("cv")})


@query("cv_fn", "SELECT job_id, round(CASE WHEN count(price) < 2 OR avg(price) = 0 THEN 0 ELSE stddev_pop(price) / avg(price) END, 4) AS cv FROM cells WHERE is_sold GROUP BY 1")
def cv_fn(spark, sf_dir):
    return M.cells(spark, sf_dir).where("is_sold").groupBy("job_id").agg(rnd(C.cv(F.col("price"))).alias("cv"))


_SIDE = "CASE WHEN {s} / {n} = 0 THEN 0 ELSE sqrt(greatest({q} / {n} - ({s} / {n}) * ({s} / {n}), 0)) / ({s} / {n}) END"
#: Best split token of each (job, cell) of a coarse key, so that groups are large enough to split.
_SPLITS = f"""coarse AS (SELECT * REPLACE ('category=' || category AS cell_key) FROM cells),
tot AS (SELECT job_id, cell_key, n, s, q, {_SIDE.format(s='s', n='n', q='q')} AS cv0 FROM (SELECT job_id, cell_key, count(*) AS n, sum(price) AS s, sum(price * price) AS q FROM coarse WHERE is_sold GROUP BY 1, 2) WHERE n >= 6),
words AS (SELECT job_id, cell_key, price, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1))) AS token FROM coarse WHERE is_sold),
sides AS (SELECT w.job_id, w.cell_key, token, count(*) AS nw, sum(price) AS sw, sum(price * price) AS qw, first(n) AS n, first(s) AS s, first(q) AS q, first(cv0) AS cv0 FROM words w JOIN tot t ON w.job_id = t.job_id AND w.cell_key = t.cell_key WHERE cv0 >= 0.5 GROUP BY 1, 2, 3),
red AS (SELECT *, round((cv0 - ({_SIDE.format(s='sw', n='nw', q='qw')} * nw + {_SIDE.format(s='(s - sw)', n='(n - nw)', q='(q - qw)')} * (n - nw)) / n) / cv0 * 100, 6) AS reduction FROM sides WHERE nw >= 3 AND n - nw >= 3 AND nw / n BETWEEN 0.15 AND 0.85),
best AS (SELECT job_id, cell_key, token, reduction FROM (SELECT *, row_number() OVER (PARTITION BY job_id, cell_key ORDER BY reduction DESC, token) AS k FROM red WHERE reduction >= 20) WHERE k = 1)"""


def coarse(spark, sf_dir):
    return M.cells(spark, sf_dir).withColumn("cell_key", F.concat(F.lit("category="), F.col("category")))


@query("cell_split", f"WITH {_SPLITS} SELECT job_id, cell_key, token, round(reduction, 3) AS reduction FROM best")
def cell_split(spark, sf_dir):
    return C.best_splits(coarse(spark, sf_dir), BY).withColumn("reduction", rnd("reduction", 3))


_OPPS = f"""st AS ({_STATS.format('cells')}),
opp AS (SELECT c.listing_id, c.job_id, c.cell_key, c.price, c.title, st.median_sold, st.n_sold, st.median_sold - c.price - st.median_sold * 0.1325 AS profit FROM cells c JOIN st ON c.job_id = st.job_id AND c.cell_key = st.cell_key
WHERE c.is_active AND st.n_sold >= 3 AND coalesce(st.cv, 0) < 0.5 AND c.price / nullif(st.median_sold, 0) >= 0.15),
opps AS (SELECT *, profit / nullif(price, 0) * 100 AS margin FROM opp WHERE profit > 0)"""


def opps(spark, sf_dir):
    return C.opportunities(M.cells(spark, sf_dir), BY)


@query("cell_opps", f"WITH {_OPPS} SELECT listing_id, job_id, cell_key, n_sold, round(median_sold, 3) AS median_sold, round(profit, 3) AS profit, round(margin, 3) AS margin FROM opps")
def cell_opps(spark, sf_dir):
    return opps(spark, sf_dir).select("listing_id", "job_id", "cell_key", "n_sold", *(rnd(c, 3).alias(c) for c in ("median_sold", "profit", "margin")))


_DAYS = "SELECT job_id, cell_key, CAST(round_even(avg(d), 0) AS BIGINT) AS days FROM (SELECT job_id, cell_key, floor((epoch(ended) - epoch(created)) / 86400) AS d FROM cells WHERE is_sold) WHERE d >= 0 GROUP BY 1, 2"


@query("agg_days_cell", _DAYS)
def agg_days_cell(spark, sf_dir):
    return C.days_to_sell(M.cells(spark, sf_dir), BY)


@query("opps_persist", f"WITH {_OPPS}, dd AS ({_DAYS}) SELECT o.listing_id, o.cell_key, round(o.profit, 2) AS profit, dd.days FROM opps o LEFT JOIN dd ON dd.job_id = o.job_id AND dd.cell_key = o.cell_key")
def opps_persist(spark, sf_dir):
    days = C.days_to_sell(M.cells(spark, sf_dir), BY)
    return opps(spark, sf_dir).join(days, BY, "left").select("listing_id", "cell_key", rnd("profit", 2).alias("profit"), "days")


@query("flt_opps", f"WITH {_OPPS} SELECT listing_id, round(profit, 3) AS profit FROM opps WHERE job_id IN (SELECT job_id FROM job_categories WHERE category IN ('SMALL', 'LARGE')) AND price <= 20000 AND contains(lower(title), 'e') AND n_sold >= 4")
def flt_opps(spark, sf_dir):
    on = M.job_categories(spark, sf_dir).where(F.col("category").isin("SMALL", "LARGE")).select("job_id")
    rows = opps(spark, sf_dir).join(on, "job_id", "left_semi").where((F.col("price") <= 20000) & F.lower("title").contains("e") & (F.col("n_sold") >= 4))
    return rows.select("listing_id", rnd("profit", 3).alias("profit"))


@query("srt_page_opps", f"WITH {_OPPS} SELECT listing_id, round(margin, 3) AS margin FROM opps ORDER BY margin DESC, listing_id LIMIT 20 OFFSET 0")
def srt_page_opps(spark, sf_dir):
    keys = {"estimatedProfit": F.col("profit"), "marginPercent": F.col("margin")}
    return K.page(opps(spark, sf_dir), keys, "marginPercent", "estimatedProfit", True, 1, 20, "listing_id").select("listing_id", rnd("margin", 3).alias("margin"))


@query("agg_opps_page", f"WITH {_OPPS} SELECT count(*) AS n, round(sum(profit), 1) AS total FROM opps")
def agg_opps_page(spark, sf_dir):
    return opps(spark, sf_dir).agg(F.count("*").alias("n"), rnd(F.sum("profit"), 1).alias("total"))


@query("jn_cell_peers", f"WITH {_OPPS} SELECT o.listing_id, count(*) AS peers, round(min(c.price), 3) AS low FROM opps o JOIN cells c ON c.job_id = o.job_id AND c.cell_key = o.cell_key AND c.is_sold AND c.listing_id <> o.listing_id GROUP BY 1")
def jn_cell_peers(spark, sf_dir):
    sold = M.cells(spark, sf_dir).where("is_sold").select(*BY, F.col("listing_id").alias("peer"), F.col("price").alias("peer_price"))
    return opps(spark, sf_dir).join(sold, BY).where("peer <> listing_id").groupBy("listing_id").agg(F.count("*").alias("peers"), rnd(F.min("peer_price"), 3).alias("low"))


@query(
    "agg_facets",
    """SELECT 'category' AS axis, category AS value, count(*) FILTER (colour = 'red' AND condition = 'NEW') AS n FROM cells GROUP BY 2 UNION ALL SELECT 'colour', colour, count(*) FILTER (condition = 'NEW') FROM cells GROUP BY 2
    UNION ALL SELECT 'condition', condition, count(*) FILTER (colour = 'red') FROM cells WHERE condition IS NOT NULL GROUP BY 2""",
)
def agg_facets(spark, sf_dir):
    return C.facets(M.cells(spark, sf_dir), ["category", "colour", "condition"], {"colour": "red", "condition": "NEW"})


@query("flt_cell", "SELECT listing_id FROM cells WHERE category = 'SMALL' AND colour = 'blue'")
def flt_cell(spark, sf_dir):
    rows = M.cells(spark, sf_dir).withColumn("cell", F.create_map(F.lit("category"), F.col("category"), F.lit("colour"), F.col("colour")))
    return rows.where((F.col("cell")["category"] == "SMALL") & (F.col("cell")["colour"] == "blue")).select("listing_id")


@query("agg_cell_eval", f"SELECT count(*) AS cells, round(avg(cv), 4) AS mean_cv, count(*) FILTER (cv >= 0.5) AS wide FROM ({_STATS.format('cells')}) WHERE n_sold >= 3")
def agg_cell_eval(spark, sf_dir):
    s = C.cell_stats(M.cells(spark, sf_dir), BY).where("n_sold >= 3")
    return s.agg(F.count("*").alias("cells"), rnd(F.avg("cv")).alias("mean_cv"), F.count_if(F.col("cv") >= 0.5).alias("wide"))


@query(
    "agg_variant_stats",
    """SELECT category, n, active, sold, CAST(round_even(100.0 * sold / nullif(active + sold, 0), 0) AS BIGINT) AS sell_through, round(ps[len(ps) // 2 + 1], 3) AS median, round(CASE WHEN len(ps) < 4 THEN 0 ELSE ps[3 * len(ps) // 4 + 1] - ps[len(ps) // 4 + 1] END, 3) AS iqr,
    round(ps[len(ps) // 2 + 1] - pa[len(pa) // 2 + 1], 3) AS spread FROM (SELECT category, count(*) AS n, count(*) FILTER (is_active) AS active, count(*) FILTER (is_sold) AS sold, list_sort(list(price) FILTER (is_sold)) AS ps, list_sort(list(price) FILTER (is_active)) AS pa FROM cells GROUP BY 1)""",
)
def agg_variant_stats(spark, sf_dir):
    # Upper medians and quartiles are order statistics; ranks by window keep the prices out of a single value.
    rows = M.cells(spark, sf_dir).withColumn("kind", F.when(F.col("is_sold"), "s").otherwise("a"))
    w = Window.partitionBy("category", "kind")
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy("price", "listing_id"))).withColumn("m", F.count("*").over(w))
    at = lambda k, kind: F.max(F.when((F.col("kind") == kind) & (F.col("r") == F.expr(k) + 1), F.col("price")))
    g = ranked.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.count_if("is_sold").alias("sold"), at("m div 2", "s").alias("median"), at("m div 4", "s").alias("q1"), at("3 * m div 4", "s").alias("q3"), at("m div 2", "a").alias("ask"))
    iqr = F.when(F.col("sold") < 4, 0.0).otherwise(F.col("q3") - F.col("q1"))
    return g.select("category", "n", "active", "sold", K.sell_through(F.col("active"), F.col("sold")).alias("sell_through"), rnd("median", 3).alias("median"), rnd(iqr, 3).alias("iqr"), rnd(F.col("median") - F.col("ask"), 3).alias("spread"))


@query(
    "agg_cluster_stats",
    """SELECT job_id, colour, count(*) AS n, count(*) FILTER (is_active) AS active, count(*) FILTER (is_sold) AS sold, round(min(price), 3) AS low, round(max(price), 3) AS high,
    list_aggregate(list_slice(list_sort(list(title) FILTER (is_sold)), 1, 2), 'string_agg', '|') AS samples FROM cells GROUP BY 1, 2 HAVING n >= 3""",
)
def agg_cluster_stats(spark, sf_dir):
    rows = M.cells(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("job_id", "colour", "is_sold").orderBy("title"))
    sample = F.when(F.col("is_sold") & (F.col("k") <= 2), F.col("title"))
    g = rows.withColumn("k", k).groupBy("job_id", "colour").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.count_if("is_sold").alias("sold"), rnd(F.min("price"), 3).alias("low"), rnd(F.max("price"), 3).alias("high"), F.array_sort(F.collect_list(sample)).alias("s"))
    return g.where("n >= 3").select("job_id", "colour", "n", "active", "sold", "low", "high", F.when(F.size("s") > 0, F.array_join("s", "|")).alias("samples"))


@query(
    "agg_tool_stats",
    """WITH p AS (SELECT price, listing_id, date_diff('day', created, coalesce(ended, TIMESTAMP '2002-01-01')) AS d FROM cells WHERE category = 'SMALL'), top AS (SELECT price FROM (SELECT * FROM p ORDER BY d, listing_id LIMIT 200) WHERE price > 0)
    SELECT (SELECT count(*) FROM p) AS n, (SELECT round(min(price), 3) FROM p) AS low, (SELECT round(max(price), 3) FROM p) AS high, (SELECT round(list_sort(list(price))[count(*) // 2 + 1], 3) FROM top) AS median,
    (SELECT round(list_sort(list(price))[3 * count(*) // 4 + 1] - list_sort(list(price))[count(*) // 4 + 1], 3) FROM top) AS iqr""",
)
def agg_tool_stats(spark, sf_dir):
    rows = M.cells(spark, sf_dir).where("category = 'SMALL'")
    top = rows.orderBy(K.days_on_market(M.as_of()), "listing_id").limit(200).where("price > 0").agg(F.array_sort(F.collect_list("price")).alias("p"))
    at = lambda k: F.try_element_at("p", F.expr(f"cast({k} as int) + 1"))
    median = top.select(rnd(at("size(p) div 2"), 3).alias("median"), rnd(at("3 * size(p) div 4") - at("size(p) div 4"), 3).alias("iqr"))
    return rows.agg(F.count("*").alias("n"), rnd(F.min("price"), 3).alias("low"), rnd(F.max("price"), 3).alias("high")).crossJoin(F.broadcast(median))


@query("agg_coverage", "SELECT round(100.0 * count(*) FILTER (colour <> '' AND condition IS NOT NULL) / count(*), 4) AS coverage, count(DISTINCT cell_key) AS cells, round((SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM cells GROUP BY cell_key)), 3) AS median_size FROM cells")
def agg_coverage(spark, sf_dir):
    sizes = M.cells(spark, sf_dir).groupBy("cell_key").agg(F.count("*").alias("n"), F.count_if((F.col("colour") != "") & F.col("condition").isNotNull()).alias("full"))
    return sizes.agg(rnd(F.lit(100.0) * F.sum("full") / F.sum("n")).alias("coverage"), F.count("*").alias("cells"), rnd(F.percentile("n", F.lit(0.5)), 3).alias("median_size"))
