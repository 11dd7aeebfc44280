"""Comparables, predictions and price analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pricing as P
from ..registry import query
from ..sources import mapping as M
from ..sources.mapping import rnd


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, integers as bigint, so that both engines give the same values."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((rnd(c, digits) if kind in ("double", "float") else c.cast("double") if kind.startswith("decimal") else c.cast("bigint") if kind in ("int", "smallint", "tinyint") else c).alias(name))
    return df.select(cols)


def comps(spark, sf_dir: str) -> DataFrame:
    return P.directed_comps(M.edges(spark, sf_dir), M.listings(spark, sf_dir))


def preds(spark, sf_dir: str, o: P.PricingOptions = P.DEFAULTS) -> DataFrame:
    return P.predictions(comps(spark, sf_dir), M.as_of(), o)


PRED_COLUMNS = "active_id, job_id, n, outliers_removed, round(mean_price, 4) AS mean_price, round(median_price, 4) AS median_price, round(confidence, 4) AS confidence, days_to_sell, round(profit, 4) AS profit"


@query("agg_predict", f"SELECT {PRED_COLUMNS} FROM preds")
def agg_predict(spark, sf_dir):
    return rounded(preds(spark, sf_dir)).select("active_id", "job_id", "n", "outliers_removed", "mean_price", "median_price", "confidence", "days_to_sell", "profit")


@query("jn_comps", "SELECT active_id, count(*) AS n, count(DISTINCT sold_id) AS n_sold, round(sum(sold_price), 2) AS total FROM comps GROUP BY active_id")
def jn_comps(spark, sf_dir):
    return comps(spark, sf_dir).groupBy("active_id").agg(F.count("*").alias("n"), F.countDistinct("sold_id").alias("n_sold"), rnd(F.sum("sold_price"), 2).alias("total"))


@query("jn_comps_condition", "SELECT a_condition AS condition, count(*) AS n FROM comps WHERE a_condition = s_condition GROUP BY 1")
def jn_comps_condition(spark, sf_dir):
    return comps(spark, sf_dir).where("a_condition = s_condition").groupBy(F.col("a_condition").alias("condition")).agg(F.count("*").alias("n"))


@query("jn_price_band", "SELECT active_id, count(*) AS n, round(avg(sold_price), 4) AS mean_price FROM comps WHERE ask > 0 AND sold_price BETWEEN ask / 2 AND ask * 2 GROUP BY 1")
def jn_price_band(spark, sf_dir):
    rows = comps(spark, sf_dir).where((F.col("ask") > 0) & F.col("sold_price").between(F.col("ask") / 2, F.col("ask") * 2))
    return rows.groupBy("active_id").agg(F.count("*").alias("n"), rnd(F.avg("sold_price"), 4).alias("mean_price"))


@query("jn_left_median", "SELECT active_id, round(profit, 4) AS profit, round(median_price, 4) AS median_price FROM preds")
def jn_left_median(spark, sf_dir):
    return rounded(preds(spark, sf_dir).select("active_id", "profit", "median_price"))


@query("win_iqr", "SELECT active_id, count(*) AS n, round(quantile_cont(sold_price, 0.25), 4) AS q1, round(quantile_cont(sold_price, 0.75), 4) AS q3 FROM comps WHERE sold_price > 0 GROUP BY 1")
def win_iqr(spark, sf_dir):
    return rounded(P.quartiles(comps(spark, sf_dir)).groupBy("active_id").agg(F.count("*").alias("n"), F.first("q1").alias("q1"), F.first("q3").alias("q3")))


@query("win_outlier", "SELECT active_id, count(*) AS kept, first(n) - count(*) AS removed FROM cleaned GROUP BY 1")
def win_outlier(spark, sf_dir):
    return P.without_outliers(P.quartiles(comps(spark, sf_dir))).groupBy("active_id").agg(F.count("*").alias("kept"), (F.first("n") - F.count("*")).alias("removed"))


@query("win_median", "SELECT active_id, round(quantile_cont(sold_price, 0.5), 4) AS median_price FROM cleaned GROUP BY 1")
def win_median(spark, sf_dir):
    return P.without_outliers(P.quartiles(comps(spark, sf_dir))).groupBy("active_id").agg(rnd(F.percentile("sold_price", F.lit(0.5)), 4).alias("median_price"))


@query(
    "agg_weighted_mean",
    f"""SELECT active_id, round(sum(sold_price * w) / nullif(sum(w), 0), 4) AS mean_price FROM (SELECT *, pow(coalesce(confidence, similarity), 2) *
    CASE WHEN ended IS NULL THEN 1 ELSE exp(-date_diff('day', ended, TIMESTAMP '{M.AS_OF}') / 30.0::DOUBLE) END AS w FROM comps WHERE sold_price IS NOT NULL) GROUP BY 1""",
)
def agg_weighted_mean(spark, sf_dir):
    w = P.weight(P.DEFAULTS, M.as_of())
    rows = comps(spark, sf_dir).where("sold_price IS NOT NULL")
    return rows.groupBy("active_id").agg(rnd(F.sum(F.col("sold_price") * w) / F.nullif(F.sum(w), F.lit(0.0)), 4).alias("mean_price"))


_PROFIT = """SELECT active_id, round({0}, 4) AS profit FROM (SELECT active_id, avg(sold_price) AS m, first(ask) AS ask, first(shipping) AS shipping FROM comps GROUP BY 1)"""


@query("agg_profit", _PROFIT.format("CAST(CAST(m + 3e-7 AS DECIMAL(18, 2)) AS DOUBLE) * 0.8675 - ask - coalesce(shipping, 0)"))
def agg_profit(spark, sf_dir):
    g = comps(spark, sf_dir).groupBy("active_id").agg(F.avg("sold_price").alias("m"), F.first("ask").alias("ask"), F.first("shipping").alias("shipping"))
    return g.select("active_id", rnd(P.profit(F.col("m") + M.NUDGE, F.col("ask"), F.col("shipping"), 13.25), 4).alias("profit"))


@query("agg_profit_no_fee", _PROFIT.format("CAST(CAST(m + 3e-7 AS DECIMAL(18, 2)) AS DOUBLE) - ask"))
def agg_profit_no_fee(spark, sf_dir):
    g = comps(spark, sf_dir).groupBy("active_id").agg(F.avg("sold_price").alias("m"), F.first("ask").alias("ask"), F.first("shipping").alias("shipping"))
    return g.select("active_id", rnd(P.profit(F.col("m") + M.NUDGE, F.col("ask"), F.col("shipping"), 0), 4).alias("profit"))


@query(
    "agg_confidence",
    """SELECT active_id, round(0.3 * (1 - exp(-count(*) / 20.0::DOUBLE)) + 0.4 * avg(coalesce(confidence, similarity)) +
    0.3 * CASE WHEN count(*) = 1 THEN 0 ELSE greatest(0, 1 - stddev_samp(sold_price) / nullif(avg(sold_price), 0)) END, 4) AS confidence FROM comps WHERE sold_price > 0 GROUP BY 1""",
)
def agg_confidence(spark, sf_dir):
    return comps(spark, sf_dir).where("sold_price > 0").groupBy("active_id").agg(rnd(P.confidence(P.DEFAULTS), 4).alias("confidence"))


_ANALYSIS = f"""WITH r AS (SELECT part_id, price, 0.5 + ord % 50 / 100.0::DOUBLE AS confidence, ended AS sold_date FROM listings WHERE status = 'Sold' AND price IS NOT NULL),
q AS (SELECT part_id, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, count(*) AS n_all FROM r GROUP BY 1),
c AS (SELECT r.*, n_all, exp(-(epoch(TIMESTAMP '{M.AS_OF}') - epoch(sold_date)) / 86400.0::DOUBLE / 30.0::DOUBLE) AS rw FROM r JOIN q USING (part_id)
  WHERE n_all < 4 OR q1 = q3 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
a AS (SELECT part_id, count(*) AS n, first(n_all) - count(*) AS removed, avg(price) AS mean, quantile_cont(price, 0.5) AS median, sum(price * confidence) / sum(confidence) AS weighted,
  sum(price * rw) / nullif(sum(rw), 0) AS recency, min(price) AS low, max(price) AS high, coalesce(stddev_samp(price), 0) AS sd, avg(confidence) AS trust FROM c GROUP BY 1)"""


def _sold(spark, sf_dir):
    rows = M.listings(spark, sf_dir).where("status = 'Sold' AND price IS NOT NULL")
    return rows.select("part_id", "price", (0.5 + F.col("ord") % 50 / F.lit(100.0)).alias("confidence"), F.col("ended").alias("sold_date"))


@query(
    "agg_price_analyze",
    _ANALYSIS
    + """ SELECT part_id, n, removed, round(mean, 3) AS mean, round(median, 3) AS median, round(weighted, 3) AS weighted, round(recency, 3) AS recency, round(low, 3) AS low, round(high, 3) AS high,
    round(sd, 3) AS sd, round(least(1, greatest(0, 0.3 * (1 - exp(-n / 20.0::DOUBLE)) + 0.4 * trust + 0.3 * greatest(0, 1 - CASE WHEN mean <= 0 THEN 1 ELSE sd / mean END))), 4) AS score FROM a""",
)
def agg_price_analyze(spark, sf_dir):
    return P.analysis(_sold(spark, sf_dir), "part_id", M.as_of()).drop("trust").withColumns({c: rnd(c, 3) for c in ("mean", "median", "weighted", "recency", "low", "high", "sd")} | {"score": rnd("score")})


@query("agg_recommended", _ANALYSIS + " SELECT part_id, round(coalesce(recency, weighted), 3) AS recommended FROM a")
def agg_recommended(spark, sf_dir):
    return P.analysis(_sold(spark, sf_dir), "part_id", M.as_of()).select("part_id", rnd(F.coalesce("recency", "weighted"), 3).alias("recommended"))


@query(
    "jn_latest_sold",
    """SELECT l.listing, round(coalesce(s.price, l.price), 4) AS price FROM (SELECT user_id AS listing, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY 1) l LEFT JOIN
    (SELECT listing, price FROM (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY recorded DESC, history_id DESC) AS k FROM history WHERE status = 'Sold') WHERE k = 1) s USING (listing)""",
)
def jn_latest_sold(spark, sf_dir):
    """The last sold price of a listing, else its own price; that of a listing here is the value of its last event."""
    h = M.history(spark, sf_dir)
    base = M.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("listing")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    return rounded(base.join(P.latest_sold_price(h), "listing", "left").select("listing", F.coalesce("sold_price", "price").alias("price")))


#: The listing that the single-listing queries price: the first active one with a price among those of part 7.
_ONE = "(SELECT * FROM listings WHERE status = 'Active' AND part_id = 7 AND price IS NOT NULL ORDER BY listing_id LIMIT 1)"
_ONE_COMPS = f"""SELECT l.listing_id, l.condition, round(l.price, 4) AS price, round(e.similarity, 4) AS similarity FROM {_ONE} o
    JOIN edges e ON is_comparable AND (id_a = o.listing_id OR id_b = o.listing_id) JOIN listings l ON l.listing_id = CASE WHEN id_a = o.listing_id THEN id_b ELSE id_a END
    WHERE l.status = 'Sold' AND l.price > 0"""


def _one_comps(spark, sf_dir, o=P.DEFAULTS):
    """Listings and edges of the listing's part are all that its edges can meet, so the filter goes below their joins."""
    part = F.col("part_id") == 7
    rows = M.listings(spark, sf_dir).where(part)
    one = rows.where("status = 'Active' AND price IS NOT NULL").orderBy("listing_id").limit(1)
    found = P.comps_of(M.edges(spark, sf_dir, part), rows, one, o)
    return rounded(found.select("listing_id", "condition", "price", "similarity"))


@query("jn_one_comps", _ONE_COMPS)
def jn_one_comps(spark, sf_dir):
    return _one_comps(spark, sf_dir)


@query("jn_one_comps_filtered", _ONE_COMPS + " AND l.condition = o.condition AND o.price > 0 AND l.price BETWEEN o.price / 2 AND o.price * 2")
def jn_one_comps_filtered(spark, sf_dir):
    return _one_comps(spark, sf_dir, P.PricingOptions(match_condition=True, price_band=2.0))


@query(
    "jn_pred_list",
    """SELECT l.listing_id, l.title, j.search_term, round(p.profit, 4) AS profit FROM preds p JOIN listings l ON l.listing_id = p.active_id LEFT JOIN jobs j ON j.job_id = l.job_id""",
)
def jn_pred_list(spark, sf_dir):
    p, rows = preds(spark, sf_dir).select("active_id", "profit"), M.listings(spark, sf_dir).select("listing_id", "title", "job_id")
    return rounded(p.join(rows, p["active_id"] == rows["listing_id"]).join(M.jobs(spark, sf_dir), "job_id", "left").select("listing_id", "title", "search_term", "profit"))


def pred_rows(spark, sf_dir):
    """Predictions with their listing."""
    p = preds(spark, sf_dir).drop("job_id", "ask", "shipping").withColumnRenamed("confidence", "pred_confidence")
    rows = M.listings(spark, sf_dir)
    return rows.join(p, p["active_id"] == rows["listing_id"])


PRED_ROWS = "(SELECT l.*, p.n, p.mean_price, p.median_price, p.profit, p.days_to_sell, p.confidence AS pred_confidence FROM preds p JOIN listings l ON l.listing_id = p.active_id)"


@query("flt_predictions", f"SELECT listing_id, job_id, round(price, 4) AS price, n FROM {PRED_ROWS} WHERE job_id IN (1, 2, 3, 7) AND price <= 5000 AND n >= 5")
def flt_predictions(spark, sf_dir):
    return rounded(pred_rows(spark, sf_dir).where(F.col("job_id").isin(1, 2, 3, 7) & (F.col("price") <= 5000) & (F.col("n") >= 5)).select("listing_id", "job_id", "price", "n"))


@query("srt_page_pred", f"SELECT listing_id, round(profit, 4) AS profit, condition FROM {PRED_ROWS} ORDER BY condition DESC NULLS LAST, listing_id LIMIT 25 OFFSET 25")
def srt_page_pred(spark, sf_dir):
    return rounded(pred_rows(spark, sf_dir).orderBy(F.col("condition").desc_nulls_last(), "listing_id").offset(25).limit(25).select("listing_id", "profit", "condition"))


@query("srt_topk", f"SELECT listing_id, round(profit, 4) AS profit FROM {PRED_ROWS} ORDER BY profit DESC, listing_id LIMIT 10")
def srt_topk(spark, sf_dir):
    return rounded(pred_rows(spark, sf_dir).orderBy(F.desc("profit"), "listing_id").limit(10).select("listing_id", "profit"))


@query("agg_pred_kpi", f"SELECT coalesce(condition, 'Unknown') AS condition, count(*) AS n, round(sum(profit), 2) AS profit, round(avg(days_to_sell), 4) AS days FROM {PRED_ROWS} GROUP BY 1")
def agg_pred_kpi(spark, sf_dir):
    g = pred_rows(spark, sf_dir).groupBy(F.coalesce("condition", F.lit("Unknown")).alias("condition"))
    return g.agg(F.count("*").alias("n"), rnd(F.sum("profit"), 2).alias("profit"), rnd(F.avg("days_to_sell"), 4).alias("days"))


@query("agg_overview_kpi", f"SELECT job_id, count(*) AS n, round(sum(profit), 2) AS total, round(avg(profit), 4) AS mean FROM {PRED_ROWS} GROUP BY 1 ORDER BY n DESC, job_id LIMIT 10")
def agg_overview_kpi(spark, sf_dir):
    g = pred_rows(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n"), rnd(F.sum("profit"), 2).alias("total"), rnd(F.avg("profit"), 4).alias("mean"))
    return g.orderBy(F.desc("n"), "job_id").limit(10)


@query("prj_profit_override", f"SELECT listing_id, round(mean_price - price, 4) AS profit FROM {PRED_ROWS}")
def prj_profit_override(spark, sf_dir):
    fee = band = None
    stored = F.lit(fee is not None or band is not None)
    return rounded(pred_rows(spark, sf_dir).select("listing_id", F.when(stored, F.col("profit")).otherwise(F.col("mean_price") - F.col("price")).alias("profit")))


@query(
    "prj_detail",
    """SELECT l.listing_id, CASE WHEN c.n IS NOT NULL THEN 'classifier' ELSE 'none' END AS source, coalesce(c.n, 0) AS n_comps, round(p.profit, 4) AS profit FROM listings l
    LEFT JOIN (SELECT active_id, count(*) AS n FROM comps GROUP BY 1) c ON c.active_id = l.listing_id LEFT JOIN preds p ON p.active_id = l.listing_id WHERE l.status = 'Active'""",
)
def prj_detail(spark, sf_dir):
    rows = M.listings(spark, sf_dir).where("status = 'Active'").select(F.col("listing_id").alias("active_id"))
    c = comps(spark, sf_dir).groupBy("active_id").agg(F.count("*").alias("n_comps"))
    out = rows.join(c, "active_id", "left").join(preds(spark, sf_dir).select("active_id", "profit"), "active_id", "left")
    return rounded(out.select(F.col("active_id").alias("listing_id"), F.when(F.col("n_comps").isNotNull(), "classifier").otherwise("none").alias("source"), F.coalesce("n_comps", F.lit(0)).alias("n_comps"), "profit"))


@query("set_union_all", "SELECT x, count(*) AS degree FROM (SELECT id_a AS x FROM edges UNION ALL SELECT id_b FROM edges) GROUP BY x")
def set_union_all(spark, sf_dir):
    e = M.edges(spark, sf_dir)
    return e.select(F.explode(F.array("id_a", "id_b")).alias("x")).groupBy("x").agg(F.count("*").alias("degree"))


@query(
    "jn_anti_verdict",
    """WITH cand AS (SELECT id_a, id_b FROM edges WHERE similarity >= 0.7), cache AS (SELECT id_a, id_b FROM edges WHERE is_comparable)
    SELECT (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM cand ANTI JOIN cache USING (id_a, id_b)) AS to_classify, (SELECT count(*) FROM cand SEMI JOIN cache USING (id_a, id_b)) AS cached""",
)
def jn_anti_verdict(spark, sf_dir):
    e = M.edges(spark, sf_dir)
    cand = e.where("similarity >= 0.7").select("id_a", "id_b").withColumn("c", F.lit(True))
    known = e.where("is_comparable").select("id_a", "id_b").distinct().withColumn("k", F.lit(True))
    return cand.join(known, ["id_a", "id_b"], "left").agg(F.count("*").alias("candidates"), F.count_if(F.col("k").isNull()).alias("to_classify"), F.count("k").alias("cached"))


@query("agg_conf_hist", "SELECT CASE WHEN confidence >= 0.95 THEN '.95' WHEN confidence >= 0.9 THEN '.90' WHEN confidence >= 0.8 THEN '.80' WHEN confidence >= 0.5 THEN '.50' ELSE 'low' END AS bucket, count(*) AS n FROM edges GROUP BY 1")
def agg_conf_hist(spark, sf_dir):
    c = F.col("confidence")
    return M.edges(spark, sf_dir).groupBy(F.when(c >= 0.95, ".95").when(c >= 0.9, ".90").when(c >= 0.8, ".80").when(c >= 0.5, ".50").otherwise("low").alias("bucket")).agg(F.count("*").alias("n"))


#: Rank buckets of the report (fixed values); ranks beyond the last have none.
RANK_BUCKETS = [(1, 10), (11, 20), (21, 30), (31, 50), (51, 100), (101, 200), (201, 300), (301, 500)]
_RANK_BUCKET = "CASE " + " ".join(f"WHEN k BETWEEN {lo} AND {hi} THEN '{lo}-{hi}'" for lo, hi in RANK_BUCKETS) + " END"


@query(
    "agg_kanalysis",
    f"""WITH r AS (SELECT active_id, similarity, confidence, row_number() OVER (PARTITION BY active_id ORDER BY similarity DESC, sold_id) AS k FROM comps),
    g AS (SELECT k, count(*) AS n, count(*) FILTER (coalesce(confidence, 0) >= 0.75) AS accepted, round(avg(similarity), 4) AS sim, round(avg(confidence), 4) AS conf FROM r GROUP BY k)
    SELECT k, n, accepted, n - accepted AS rejected, round(100.0 * accepted / n, 4) AS accept_percent, sim, conf, CAST(sum(accepted) OVER (ORDER BY k) AS BIGINT) AS cumulative, {_RANK_BUCKET} AS bucket FROM g""",
)
def agg_kanalysis(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("active_id").orderBy(F.desc("similarity"), "sold_id"))
    accepted = F.count_if(F.coalesce("confidence", F.lit(0.0)) >= 0.75)
    g = comps(spark, sf_dir).withColumn("k", k.cast("bigint")).groupBy("k").agg(F.count("*").alias("n"), accepted.alias("accepted"), rnd(F.avg("similarity"), 4).alias("sim"), rnd(F.avg("confidence"), 4).alias("conf"))
    g = g.withColumn("rejected", F.col("n") - F.col("accepted")).withColumn("accept_percent", rnd(F.lit(100.0) * F.col("accepted") / F.col("n")))
    return g.withColumn("cumulative", P.running_total(g, "k", "accepted")).withColumn("bucket", F.expr(_RANK_BUCKET))


@query("win_cumulative_rank", "WITH g AS (SELECT CAST(round(similarity * 100) AS BIGINT) AS s, count(*) AS n FROM edges GROUP BY 1) SELECT s, n, CAST(sum(n) OVER (ORDER BY s) AS BIGINT) AS cumulative FROM g")
def win_cumulative_rank(spark, sf_dir):
    g = M.edges(spark, sf_dir).groupBy(rnd(F.col("similarity") * 100).cast("bigint").alias("s")).agg(F.count("*").alias("n"))
    return g.withColumn("cumulative", P.running_total(g, "s", "n"))
