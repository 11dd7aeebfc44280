"""Vectors, neighbours, pair classification, label metrics and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import vectors as V
from ..registry import query
from ..sources import mapping as M
from ..sources.mapping import rnd
from .pricing_queries import rounded

_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def vectors(spark, sf_dir):
    return M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def queries(spark, sf_dir):
    return vectors(spark, sf_dir).where("id % 100 = 0")


@query("vec_normalize", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS first FROM embeddings")
def vec_normalize(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), rnd(V.normalized(F.col("v").cast("array<double>"))[0], 5).alias("first"))


@query("vec_cosine", f"SELECT a.vec_id, round({_COS.format('a.embedding', 'b.embedding')}, 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine(spark, sf_dir):
    a = vectors(spark, sf_dir)
    b = a.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return a.join(b, "id").select(F.col("id").alias("vec_id"), rnd(V.cosine(F.col("v"), F.col("w")), 5).alias("cosine"))


def _knn(k: int, where: str = "true") -> str:
    return f"""SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM
    (SELECT q.vec_id AS query, c.vec_id AS id, {_COS.format('q.embedding', 'c.embedding')} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND {where})) WHERE rank <= {k}"""


@query("knn_topk", f"SELECT query, id, round(score, 5) AS score, rank FROM ({_knn(30)})")
def knn_topk(spark, sf_dir):
    return V.knn(vectors(spark, sf_dir), queries(spark, sf_dir), 30).withColumn("score", rnd("score", 5))


@query("knn_search", f"SELECT query, id, round(score, 5) AS score FROM ({_knn(30)}) WHERE score >= 0.2")
def knn_search(spark, sf_dir):
    return V.knn(vectors(spark, sf_dir), queries(spark, sf_dir), 30).where("score >= 0.2").select("query", "id", rnd("score", 5).alias("score"))


@query("knn_similar", f"SELECT query, id, round(score, 5) AS score FROM ({_knn(10, 'q.vec_id <> c.vec_id')}) WHERE score >= 0.2")
def knn_similar(spark, sf_dir):
    return V.knn(vectors(spark, sf_dir), queries(spark, sf_dir), 10, drop_self=True).where("score >= 0.2").select("query", "id", rnd("score", 5).alias("score"))


@query("win_knn_rank", f"SELECT query, id, rank FROM ({_knn(5, 'q.vec_id <> c.vec_id')})")
def win_knn_rank(spark, sf_dir):
    return V.knn(vectors(spark, sf_dir), queries(spark, sf_dir), 5, drop_self=True).select("query", "id", "rank")


@query("knn_candidates", f"SELECT a, b, round(max(score), 5) AS score FROM (SELECT least(query, id) AS a, greatest(query, id) AS b, score FROM ({_knn(100, 'q.vec_id <> c.vec_id')}) k JOIN embeddings e ON e.vec_id = k.id WHERE e.label < 5 AND score >= 0.15 AND (query + id) % 4 <> 0) GROUP BY 1, 2")
def knn_candidates(spark, sf_dir):
    v = vectors(spark, sf_dir)
    hits = V.knn(v, queries(spark, sf_dir), 100, drop_self=True).where("score >= 0.15").join(v.where("label < 5").select("id"), "id", "left_semi")
    pairs = hits.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    known = pairs.where("(a + b) % 4 = 0").select("a", "b")
    return pairs.join(known, ["a", "b"], "left_anti").withColumn("score", rnd("score", 5))


@query("scr_search_join", f"SELECT k.query, k.id, coalesce(CAST(e.label AS VARCHAR), 'unknown') AS label FROM ({_knn(5)}) k LEFT JOIN (SELECT * FROM embeddings WHERE label <> 3) e ON e.vec_id = k.id")
def scr_search_join(spark, sf_dir):
    hits = V.knn(vectors(spark, sf_dir), queries(spark, sf_dir), 5)
    known = vectors(spark, sf_dir).where("label <> 3").select("id", F.col("label").cast("string").alias("label"))
    return hits.join(known, "id", "left").select("query", "id", F.coalesce("label", F.lit("unknown")).alias("label"))


@query("dist_matrix", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def dist_matrix(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a, b = v.select("label", F.col("id").alias("a"), F.col("v").alias("va")), v.select("label", F.col("id").alias("b"), F.col("v").alias("vb"))
    square = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "label").where("a < b").select("a", "b", rnd(F.sqrt(square), 5).alias("distance"))


@query("scr_equiv_pairs", f"SELECT a, b, round(s, 5) AS s FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE s > 0.2 ORDER BY s DESC, a, b LIMIT 30")
def scr_equiv_pairs(spark, sf_dir):
    return V.top_pairs(vectors(spark, sf_dir), 30, 0.2, 5, M.NUDGE)  # the SQL's ORDER BY takes the rounded s


@query("scr_separability", f"SELECT same, count(*) AS n, round(min(s), 5) AS low, round(max(s), 5) AS high, round(avg(s), 5) AS mean FROM (SELECT a.label = b.label AS same, {_COS.format('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0) GROUP BY 1")
def scr_separability(spark, sf_dir):
    v = vectors(spark, sf_dir)
    hits = V.knn(v, queries(spark, sf_dir), v.count(), drop_self=True)
    label = v.select("id", "label")
    rows = hits.join(label, "id").join(label.withColumnsRenamed({"id": "query", "label": "own"}), "query")
    s = F.col("score")
    return rows.groupBy((F.col("label") == F.col("own")).alias("same")).agg(F.count("*").alias("n"), rnd(F.min(s), 5).alias("low"), rnd(F.max(s), 5).alias("high"), rnd(F.avg(s), 5).alias("mean"))


_ENS = "1 / (1 + exp(-(2.4910 * logit + 0.4324 * similarity - 2.6254)))"


@query("ensemble", f"SELECT pair_id, round({_ENS}, 5) AS p, {_ENS} > 0.5 AS comparable FROM pairs")
def ensemble(spark, sf_dir):
    p = V.ensemble_score(F.col("logit"), F.col("similarity"))
    return M.pairs(spark, sf_dir).select("pair_id", rnd(p, 5).alias("p"), (p > 0.5).alias("comparable"))


@query("softmax", "SELECT pair_id, CAST(similarity > logit AS BIGINT) AS label, round(1 / (1 + exp(-abs(similarity - logit))), 5) AS probability, round(similarity - logit, 5) AS difference FROM pairs")
def softmax(spark, sf_dir):
    parts = V.softmax2(F.col("logit"), F.col("similarity"))
    return M.pairs(spark, sf_dir).select("pair_id", parts["label"].cast("bigint").alias("label"), rnd(parts["probability"], 5).alias("probability"), rnd(parts["difference"], 5).alias("difference"))


_ANSWER = "CASE pair_id % 4 WHEN 0 THEN 'SAME' WHEN 1 THEN 'different' WHEN 2 THEN 'uncertain' END"


@query("verdict_map", "SELECT pair_id, pair_id % 4 = 0 AS comparable, CASE pair_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM pairs")
def verdict_map(spark, sf_dir):
    yes, trust = V.verdict(F.expr(_ANSWER))
    return M.pairs(spark, sf_dir).select("pair_id", yes.alias("comparable"), trust.alias("confidence"))


_BUCKET = "CASE WHEN c >= 0.95 THEN '.95' WHEN c >= 0.9 THEN '.90' WHEN c >= 0.8 THEN '.80' ELSE '.50' END"


@query("agg_calibration", f"SELECT {_BUCKET} AS bucket, count(*) AS n, round(avg(CASE WHEN (p > 0.5) = comparable THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg(c), 4) AS mean, round(-avg(ln(CASE WHEN comparable THEN p ELSE 1 - p END)), 4) AS nll FROM (SELECT comparable, {_ENS} AS p, greatest({_ENS}, 1 - {_ENS}) AS c FROM pairs) GROUP BY 1")
def agg_calibration(spark, sf_dir):
    p = V.ensemble_score(F.col("logit"), F.col("similarity"))
    rows = M.pairs(spark, sf_dir).select("comparable", p.alias("p")).withColumn("c", F.greatest("p", 1 - F.col("p")))
    hit = F.when((F.col("p") > 0.5) == F.col("comparable"), 1.0).otherwise(0.0)
    nll = -F.avg(F.log(F.when(F.col("comparable"), F.col("p")).otherwise(1 - F.col("p"))))
    return rows.groupBy(F.expr(_BUCKET).alias("bucket")).agg(F.count("*").alias("n"), rnd(F.avg(hit)).alias("accuracy"), rnd(F.avg("c")).alias("mean"), rnd(nll).alias("nll"))


_CONF = f"(SELECT job_id, comparable AS y, {_ENS} > 0.5 AS p FROM pairs)"


@query(
    "agg_metrics",
    f"""SELECT job_id, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(f1, 4) AS f1, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (f1 + f0) / 2 END, 4) AS f1_macro,
    round((coalesce(tp / nullif(tp + fp, 0), 0) * k1 + coalesce(tn / nullif(tn + fn, 0), 0) * k0) / (k1 + k0), 4) AS precision_macro, round((coalesce(tp / nullif(tp + fn, 0), 0) * k1 + coalesce(tn / nullif(tn + fp, 0), 0) * k0) / (k1 + k0), 4) AS recall_macro FROM
    (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0, CAST(tp + fp + fn > 0 AS DOUBLE) AS k1, CAST(tn + fp + fn > 0 AS DOUBLE) AS k0 FROM (SELECT job_id, CAST(count(*) FILTER (y AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT y AND p) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (y AND NOT p) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT y AND NOT p) AS DOUBLE) AS tn FROM {_CONF} GROUP BY 1))""",
)
def agg_metrics(spark, sf_dir):
    p = V.ensemble_score(F.col("logit"), F.col("similarity")) > 0.5
    return rounded(V.binary_metrics(M.pairs(spark, sf_dir).select("job_id", F.col("comparable").alias("label"), p.alias("predicted")), ["job_id"]))


@query("agg_class_weights", "SELECT quality, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 5) AS weight FROM labels GROUP BY 1")
def agg_class_weights(spark, sf_dir):
    g = M.read(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return g.crossJoin(F.broadcast(total)).select("quality", rnd(F.col("total") / (F.col("k") * F.col("n")), 5).alias("weight"))


@query("agg_disagree", f"SELECT job_id, count(*) FILTER (y = p) AS agree, count(*) FILTER (y <> p) AS disagree, count(*) FILTER (p) AS positive, round(count(*) FILTER (y <> p) / count(*), 4) AS rate FROM {_CONF} GROUP BY 1 ORDER BY rate DESC, job_id LIMIT 30")
def agg_disagree(spark, sf_dir):
    rows = M.pairs(spark, sf_dir).select("job_id", F.col("comparable").alias("y"), (V.ensemble_score(F.col("logit"), F.col("similarity")) > 0.5).alias("p"))
    g = rows.groupBy("job_id").agg(F.count_if(F.col("y") == F.col("p")).alias("agree"), F.count_if(F.col("y") != F.col("p")).alias("disagree"), F.count_if("p").alias("positive"))
    return g.withColumn("rate", rnd(F.col("disagree") / (F.col("agree") + F.col("disagree")))).orderBy(F.desc("rate"), "job_id").limit(30)


@query("agg_source_mix", "SELECT source, count(*) FILTER (quality = 0) AS zero, count(*) FILTER (quality = 1) AS one FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agg_source_mix(spark, sf_dir):
    rows = M.read(spark, sf_dir, "documents").select("doc_id", "source").join(M.read(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("zero"), F.count_if(F.col("quality") == 1).alias("one"))


@query("agg_extraction_score", "SELECT axis, count(*) FILTER (e IS NOT NULL AND a = e) AS tp, count(*) FILTER (e IS NULL AND a IS NULL) AS tn, count(*) FILTER (e IS NULL AND a IS NOT NULL) AS fp, count(*) FILTER (e IS NOT NULL AND a IS NULL) AS fn, count(*) FILTER (a <> e) AS wrong FROM (SELECT coalesce(x.axis, y.axis) AS axis, x.v AS e, y.v AS a FROM (SELECT listing_id, 'category' AS axis, category AS v FROM cells) x FULL JOIN (SELECT listing_id, CASE WHEN job_id % 3 = 0 THEN 'colour' ELSE 'category' END AS axis, CASE WHEN job_id % 7 = 0 THEN NULL WHEN job_id % 5 = 0 THEN 'SMALL' ELSE category END AS v FROM cells) y ON x.listing_id = y.listing_id AND x.axis = y.axis) GROUP BY 1")
def agg_extraction_score(spark, sf_dir):
    rows = M.cells(spark, sf_dir)
    e = rows.select("listing_id", F.lit("category").alias("axis"), F.col("category").alias("e"))
    got = F.when(F.col("job_id") % 7 == 0, None).when(F.col("job_id") % 5 == 0, "SMALL").otherwise(F.col("category"))
    a = rows.select("listing_id", F.when(F.col("job_id") % 3 == 0, "colour").otherwise("category").alias("axis"), got.alias("a"))
    j, n = e.join(a, ["listing_id", "axis"], "full"), F.count_if
    x, y = F.col("e"), F.col("a")
    return j.groupBy("axis").agg(n(x == y).alias("tp"), n(x.isNull() & y.isNull()).alias("tn"), n(x.isNull() & y.isNotNull()).alias("fp"), n(x.isNotNull() & y.isNull()).alias("fn"), n(x != y).alias("wrong"))


@query("agg_mine_stats", "SELECT job_id, count(*) FILTER (a LIKE '%i_ %' AND b LIKE '%i_ %') AS both_cpu, count(*) AS n FROM pairs GROUP BY 1")
def agg_mine_stats(spark, sf_dir):
    cpu = lambda c: F.col(c).like("%i_ %")
    return M.pairs(spark, sf_dir).groupBy("job_id").agg(F.count_if(cpu("a") & cpu("b")).alias("both_cpu"), F.count("*").alias("n"))


_TERMS = "(SELECT doc_id AS doc, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]', ' ', 'g'), ' +'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in X.TFIDF_STOP_WORDS) + "))) AS term FROM documents)"


@query(
    "tfidf",
    f"""WITH t AS (SELECT doc, term, count(*) AS tf FROM {_TERMS} GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc) AS n FROM t), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
    w AS (SELECT doc, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN d USING (term), n WHERE df >= 5 AND df <= 0.8 * n)
    SELECT doc, count(*) AS terms, round(max(w / l), 5) AS top FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc)) AS l FROM w) GROUP BY 1""",
)
def tfidf(spark, sf_dir):
    rows = M.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(X.tfidf_tokens(F.col("text"))).alias("term"))
    return V.tfidf(rows).groupBy("doc").agg(F.count("*").alias("terms"), rnd(F.max("weight"), 5).alias("top"))


# ---- sets

_SETS = "(SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS s FROM benchmark WHERE text IS NOT NULL)"


def _sets(spark, sf_dir):
    return M.read(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))


def _overlaps(spark, sf_dir):
    """Sizes and common words of all pairs of sets that share a word, through an inverted index."""
    rows = _sets(spark, sf_dir)
    size = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    pairs = rows.withColumnRenamed("item_id", "a").join(rows.withColumnRenamed("item_id", "b"), "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    return pairs.join(size.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")


_PAIRS = f"(SELECT x.item_id AS a, y.item_id AS b, len(x.s) AS na, len(y.s) AS nb, len(list_intersect(x.s, y.s)) AS common FROM {_SETS} x JOIN {_SETS} y ON x.item_id < y.item_id)"


@query("set_overlap", f"SELECT a, b, round(common / least(na, nb)::DOUBLE, 5) AS overlap FROM {_PAIRS} WHERE common > 0")
def set_overlap(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("a", "b", rnd(F.col("common") / F.least("na", "nb"), 5).alias("overlap"))


@query("set_jaccard", f"SELECT a, b, round(common / (na + nb - common)::DOUBLE, 5) AS jaccard FROM {_PAIRS} WHERE common > 0")
def set_jaccard(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("a", "b", rnd(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 5).alias("jaccard"))


@query("cooccur_pairs", f"SELECT a, b, common FROM {_PAIRS} WHERE common / least(na, nb)::DOUBLE > 0.5")
def cooccur_pairs(spark, sf_dir):
    return _overlaps(spark, sf_dir).where(F.col("common") / F.least("na", "nb") > 0.5).select("a", "b", "common")


@query("set_minus", f"SELECT x.item_id, CAST(len(x.s) - len(list_intersect(x.s, y.s)) AS BIGINT) AS n FROM {_SETS} x, {_SETS} y WHERE y.item_id = 0")
def set_minus(spark, sf_dir):
    rows = _sets(spark, sf_dir)
    left = rows.join(rows.where("item_id = 0").select("w"), "w", "left_anti").groupBy("item_id").agg(F.count("*").alias("n"))
    return rows.select("item_id").distinct().join(left, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("set_subset", f"SELECT a, b FROM {_PAIRS} WHERE common = least(na, nb)")
def set_subset(spark, sf_dir):
    return _overlaps(spark, sf_dir).where(F.col("common") == F.least("na", "nb")).select("a", "b")


@query("set_overlaps", "SELECT item_id, list_has_any(list_distinct(string_split(lower(text), ' ')), ['that', 'with', 'de', 'der']) AS any FROM benchmark WHERE text IS NOT NULL")
def set_overlaps(spark, sf_dir):
    words = F.array(*(F.lit(w) for w in ("that", "with", "de", "der")))
    return M.read(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.arrays_overlap(F.split(F.lower("text"), " "), words).alias("any"))


@query("set_weighted_jaccard", "WITH c AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark WHERE text IS NOT NULL) GROUP BY 1, 2) SELECT k AS a, round(sum(least(x, y)) / sum(greatest(x, y))::DOUBLE, 5) AS similarity FROM (SELECT coalesce(p.item_id, q.item_id - 1) AS k, coalesce(p.n, 0) AS x, coalesce(q.n, 0) AS y FROM c p FULL JOIN c q ON q.item_id = p.item_id + 1 AND q.w = p.w) WHERE k >= 0 AND k < (SELECT max(item_id) FROM c) GROUP BY 1")
def set_weighted_jaccard(spark, sf_dir):
    c = M.read(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    p, q = c.select(F.col("item_id").alias("a"), "w", F.col("n").alias("x")), c.select((F.col("item_id") - 1).alias("a"), "w", F.col("n").alias("y"))
    both = p.join(q, ["a", "w"], "full").withColumn("x", F.coalesce("x", F.lit(0))).withColumn("y", F.coalesce("y", F.lit(0)))
    last = F.broadcast(c.agg(F.max("item_id").alias("last")))
    return both.crossJoin(last).where("a >= 0 AND a < last").groupBy("a").agg(rnd(F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y")), 5).alias("similarity"))


@query("set_canonical", "SELECT DISTINCT least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b FROM lineitem")
def set_canonical(spark, sf_dir):
    return M.read(spark, sf_dir, "lineitem").select(F.least("l_orderkey", "l_partkey").alias("a"), F.greatest("l_orderkey", "l_partkey").alias("b")).distinct()


@query("set_dedupe_pair", "SELECT a, b, k FROM (SELECT least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2)")
def set_dedupe_pair(spark, sf_dir):
    rows = M.read(spark, sf_dir, "lineitem").select(F.least("l_orderkey", "l_partkey").alias("a"), F.greatest("l_orderkey", "l_partkey").alias("b"), "l_suppkey")
    return rows.groupBy("a", "b").agg(F.min("l_suppkey").alias("k"))


@query("set_concat", "SELECT listing_id, min(k) AS k FROM (SELECT listing_id, 0 AS k FROM listings WHERE status = 'Sold' UNION ALL SELECT listing_id, 1 FROM listings WHERE part_id < 100) GROUP BY 1")
def set_concat(spark, sf_dir):
    rows = M.listings(spark, sf_dir)
    both = rows.where("status = 'Sold'").select("listing_id", F.lit(0).alias("k")).unionByName(rows.where("part_id < 100").select("listing_id", F.lit(1).alias("k")))
    return rounded(both.groupBy("listing_id").agg(F.min("k").alias("k")))
