"""Taxonomy, clustering and offline-script operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clustering as G
from ..operators import taxonomy as T
from ..operators import vectors as V
from ..operators.graph import components
from ..registry import query
from ..sources import mapping as M
from ..sources.mapping import rnd
from ..store import saved
from .pricing_queries import rounded
from .text_queries import _NG

#: Lower floors, so that the small samples have axes too.
O = T.TaxonomyOptions(min_unigram=10, min_ngram=5)
#: For whole runs also lower floors of cosines: the stand-in embedding knows letters, not meaning.
RUN = T.TaxonomyOptions(min_unigram=10, min_ngram=5, outlier_cosine=0.02, title_cosine=0.05)


def titles(spark, sf_dir):
    return M.titles(spark, sf_dir).select("job_id", "listing_id", "title")


_KEPT = f"{_NG}, n AS (SELECT job_id, count(*) AS n FROM titles GROUP BY 1), kept AS (SELECT job_id, g, count(DISTINCT listing_id) AS df FROM ng JOIN n USING (job_id) GROUP BY job_id, g, n.n HAVING df >= greatest(CASE WHEN contains(g, ' ') THEN 5 ELSE 10 END, n.n // 200)), mm AS (SELECT DISTINCT job_id, listing_id, g FROM ng JOIN kept USING (job_id, g))"
_LONGEST = f"{_KEPT}, kw AS (SELECT job_id, g, list_sort(list_distinct(string_split(g, ' '))) AS w FROM kept), cov AS (SELECT a.job_id, b.g, a.g AS short FROM kw a JOIN kw b ON a.job_id = b.job_id AND len(a.w) < len(b.w) AND list_has_all(b.w, a.w)), lm AS (SELECT * FROM mm ANTI JOIN (SELECT mm.job_id, listing_id, short AS g FROM mm JOIN cov USING (job_id, g)) USING (job_id, listing_id, g))"
_SETS = f"{_LONGEST}, sg AS (SELECT lm.job_id, g, count(*) AS size FROM lm JOIN n ON n.job_id = lm.job_id GROUP BY lm.job_id, g, n.n HAVING count(*) >= greatest(1, floor(n.n * 0.03)))"
_EXCL = f"{_SETS}, pc AS (SELECT x.job_id, x.g AS a, y.g AS b, count(*) AS common FROM lm x JOIN lm y ON x.job_id = y.job_id AND x.listing_id = y.listing_id AND x.g < y.g GROUP BY 1, 2, 3), ex AS (SELECT x.job_id, x.g AS a, y.g AS b FROM sg x JOIN sg y ON x.job_id = y.job_id AND x.g < y.g LEFT JOIN pc ON pc.job_id = x.job_id AND pc.a = x.g AND pc.b = y.g WHERE coalesce(common, 0) / least(x.size, y.size)::DOUBLE < 0.05)"


def _parts(spark, sf_dir):
    """Distinct titles, n-grams, matches and significant sets; titles and matches are worked out once."""
    t = saved(T.distinct_titles(titles(spark, sf_dir)), "titles")
    kept, matches = T.extract_ngrams(t, O)
    matches = saved(T.longest_matches(kept, matches), "matches")
    return t, kept, matches, T.significant(matches, t, O)


@query("match_sets", f"WITH {_LONGEST} SELECT job_id, g, count(*) AS size FROM lm GROUP BY 1, 2")
def match_sets(spark, sf_dir):
    return _parts(spark, sf_dir)[2].groupBy("job_id", "g").agg(F.sum("weight").alias("size"))


@query("exclusive_pairs", f"WITH {_EXCL} SELECT job_id, a, b FROM ex")
def exclusive_pairs(spark, sf_dir):
    _, _, matches, sets = _parts(spark, sf_dir)
    return T.exclusive_pairs(sets, T.pair_counts(matches), O)


@query("exclusive_candidates", f"WITH {_EXCL} SELECT job_id, g, count(*) AS n FROM (SELECT job_id, a AS g FROM ex UNION ALL SELECT job_id, b FROM ex) GROUP BY 1, 2 HAVING n >= 3")
def exclusive_candidates(spark, sf_dir):
    ex = exclusive_pairs(spark, sf_dir)
    return ex.select("job_id", F.explode(F.array("a", "b")).alias("g")).groupBy("job_id", "g").agg(F.count("*").alias("n")).where("n >= 3")


@query("jn_neighbours", f"WITH {_EXCL} SELECT job_id, a, b, common FROM pc WHERE common >= 5")
def jn_neighbours(spark, sf_dir):
    return T.pair_counts(_parts(spark, sf_dir)[2]).where("common >= 5")


@query("graph_edges")
def graph_edges(spark, sf_dir):
    ex = exclusive_pairs(spark, sf_dir)

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(T.embed(x) @ T.embed(y)) for x, y in zip(a, b)])

    return ex.withColumn("weight", similarity("a", "b")).where("weight > 0.15").withColumn("weight", rnd("weight", 5))


@query("louvain")
def louvain(spark, sf_dir):
    edges = graph_edges(spark, sf_dir)

    def one(key, pdf):
        nodes = sorted({*pdf.a, *pdf.b})
        at = {g: k for k, g in enumerate(nodes)}
        labels = T.louvain(len(nodes), [(at[a], at[b], w) for a, b, w in zip(pdf.a, pdf.b, pdf.weight)])
        return pd.DataFrame({"job_id": key[0], "g": nodes, "community": labels})

    return edges.groupBy("job_id").applyInPandas(one, "job_id bigint, g string, community bigint")


def _axes(spark, sf_dir):
    t, _, matches, sets = _parts(spark, sf_dir)
    return t, matches, T.axes_of_jobs(sets, T.pair_counts(matches), O)


@query("axis_build")
def axis_build(spark, sf_dir):
    return _axes(spark, sf_dir)[2]


def _run(spark, sf_dir):
    """The whole run: titles that share no token with their job's part names, or are unlike its search term, are left out."""
    terms = M.jobs(spark, sf_dir).select("job_id", "search_term")
    rows = titles(spark, sf_dir).join(F.broadcast(terms), "job_id")
    return T.run(rows, RUN, brands=("red", "blue", "green", "small", "large", "hot"))


@query("taxonomy_run")
def taxonomy_run(spark, sf_dir):
    _, cells = _run(spark, sf_dir)
    n, covered, conflicts = F.count("*"), F.count("cell"), F.count_if("has_conflict")
    return cells.groupBy("job_id").agg(n.alias("n"), covered.alias("covered"), conflicts.alias("conflicts"), rnd(100 * covered / n, 3).alias("coverage"), rnd(100 * conflicts / n, 3).alias("conflict_share"))


@query("taxonomy_axes")
def taxonomy_axes(spark, sf_dir):
    return _run(spark, sf_dir)[0]


def _stage(name, step):
    """A query that applies one post-processing step to each job's significant n-grams, taken as one axis."""

    @query(name)
    def run(spark, sf_dir):
        _, _, matches, sets = _parts(spark, sf_dir)
        pairs = T.pair_counts(matches)

        def one(key, values, common):
            s = T.Overlaps(dict(zip(values.g, values["size"].astype(int))), {(a, b): int(c) for a, b, c in zip(common.a, common.b, common.common)})
            start = [values.sort_values(["size", "g"], ascending=[False, True]).g.tolist()]
            return pd.DataFrame([(key[0], k, v) for k, axis in enumerate(step(start, s)) for v in axis], columns=["job_id", "axis", "label"])

        return T.by_job(sets, pairs).applyInPandas(one, "job_id bigint, axis bigint, label string")

    return run


_stage("axis_dedupe_overlap", T.dedupe_overlap)
_stage("axis_dedupe_embed", lambda axes, s: T.dedupe_embed(axes))
_stage("axis_prune_overlap", T.prune_overlap)
_stage("axis_enforce_me", T.enforce_exclusive)
_stage("axis_outlier", lambda axes, s: T.drop_outliers(axes))
_stage("axis_unify", lambda axes, s: T.unify([axes[0][::2], axes[0][1::2]], s))
_stage("axis_validate", T.validated)
_stage("axis_refine", lambda axes, s: list(T.refine({"a": axes[0][::2], "b": axes[0][1::2]}, s.sizes, 1000, {"merge": {"a": ["b"]}, "rename": {"a": "variant"}, "add": {"variant": ["extra"]}}).values()))
_stage("subsume_tokens", lambda axes, s: [[g for g, _ in T.subsume([(v, s.sizes[v]) for v in axes[0]])]])


@query("synonym_merge")
def synonym_merge(spark, sf_dir):
    """Synonyms among all n-grams that pass the floors, with the frequencies of their titles, before match sets are made."""
    return T.synonyms(T.extract_ngrams(T.distinct_titles(titles(spark, sf_dir)), O)[0], O)


@query("axis_generic", f"WITH {_SETS} SELECT job_id, g FROM sg WHERE g NOT IN ('with', 'free', 'all', 'day', 'next', 'del', 'count', 'brand')")
def axis_generic(spark, sf_dir):
    return _parts(spark, sf_dir)[3].where(~F.col("g").isin(*T.GENERIC)).select("job_id", "g")


@query("substring_dedupe", f"WITH {_KEPT} SELECT s.job_id, s.g AS short, l.g AS long, CASE WHEN (s.df - l.df) / s.df::DOUBLE > 0.2 THEN l.g ELSE s.g END AS dropped FROM kept s JOIN kept l ON s.job_id = l.job_id AND s.g <> l.g AND contains(l.g, s.g) AND l.df >= 0.8 * s.df")
def substring_dedupe(spark, sf_dir):
    kept = T.extract_ngrams(T.distinct_titles(titles(spark, sf_dir)), O)[0].select("job_id", "g", "df")
    s, ln = kept.select("job_id", F.col("g").alias("short"), F.col("df").alias("ds")), kept.select("job_id", F.col("g").alias("long"), F.col("df").alias("dl"))
    both = s.join(ln, "job_id").where((F.col("short") != F.col("long")) & F.contains("long", F.col("short")) & (F.col("dl") >= 0.8 * F.col("ds")))
    return both.select("job_id", "short", "long", F.when((F.col("ds") - F.col("dl")) / F.col("ds") > 0.2, F.col("long")).otherwise(F.col("short")).alias("dropped"))


_FIXED = "(VALUES ('colour', 'red'), ('colour', 'blue'), ('colour', 'hot'), ('kind', 'ring'), ('kind', 'widget'), ('kind', 'red ring')) ax(axis, label)"


def _fixed(spark):
    return spark.createDataFrame([("colour", "red"), ("colour", "blue"), ("colour", "hot"), ("kind", "ring"), ("kind", "widget"), ("kind", "red ring")], "axis string, label string")


@query(
    "assign_cells",
    f"""WITH t AS (SELECT listing_id, lower(title) AS whole, ' ' || regexp_replace(lower(title), '[^\\p{{L}}\\p{{Nd}}]', ' ', 'g') || ' ' AS padded FROM titles),
    h AS (SELECT listing_id, axis, label FROM t, {_FIXED} WHERE CASE WHEN contains(label, ' ') THEN contains(whole, label) ELSE contains(padded, ' ' || label || ' ') END),
    v AS (SELECT listing_id, axis, list_sort(list(label)) AS v FROM h GROUP BY 1, 2), r AS (SELECT *, list_filter(v, lambda x: len(list_filter(v, lambda o: contains(x, o))) = len(v))[1] AS best FROM v)
    SELECT listing_id, string_agg(axis || '=' || coalesce(best, v[1]), ';' ORDER BY axis) AS cell, bool_or(best IS NULL) AS has_conflict FROM r GROUP BY 1""",
)
def assign_cells(spark, sf_dir):
    t, axes = titles(spark, sf_dir), _fixed(spark).withColumn("size", F.lit(0).cast("bigint"))
    m = t.crossJoin(F.broadcast(axes.select(F.col("label").alias("g")))).where(X.pattern_matches(F.col("g"), F.col("title"))).select("job_id", "listing_id", "g")
    per_job = t.select("job_id").distinct().crossJoin(F.broadcast(axes))
    cells = T.assign_cells(t, per_job, m).where("cell IS NOT NULL")
    return cells.select("listing_id", F.array_join(F.transform(F.array_sort(F.map_entries("cell")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("cell"), "has_conflict")


@query("taxonomy_topdown", f"SELECT listing_id, string_agg(axis || '=' || value, ';' ORDER BY axis) AS cell FROM (SELECT listing_id, axis, first(label ORDER BY length(label) DESC, label) AS value FROM titles, {_FIXED} WHERE contains(' ' || regexp_replace(lower(title), '[^a-z0-9]', ' ', 'g') || ' ', ' ' || label || ' ') GROUP BY 1, 2) GROUP BY 1")
def taxonomy_topdown(spark, sf_dir):
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("title"), "[^a-z0-9]", " "), F.lit(" "))
    hit = titles(spark, sf_dir).crossJoin(F.broadcast(_fixed(spark))).where(F.contains(padded, F.concat(F.lit(" "), F.col("label"), F.lit(" "))))
    best = hit.groupBy("listing_id", "axis").agg(F.min_by("label", F.struct(-F.length("label"), "label")).alias("value"))
    return best.groupBy("listing_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("axis", F.lit("="), "value"))), ";").alias("cell"))


@query("decontaminate", "SELECT listing_id, title FROM titles WHERE list_has_any(string_split(lower(title), ' '), ['red', 'blue', 'gizmo'])")
def decontaminate(spark, sf_dir):
    brand = F.array(F.lit("red"), F.lit("blue"), F.lit("gizmo"))
    return titles(spark, sf_dir).where(F.arrays_overlap(X.tokens(F.col("title")), brand)).select("listing_id", "title")


@query("decontaminate_similar")
def decontaminate_similar(spark, sf_dir):
    @F.pandas_udf("double")
    def similarity(t: pd.Series) -> pd.Series:
        name = T.embed("red ring small")
        return pd.Series([float(T.embed(x.lower()) @ name) for x in t])

    return decontaminate(spark, sf_dir).where(similarity("title") >= 0.3)


_SLOTS = "w AS (SELECT listing_id, ['__START__'] || regexp_extract_all(lower(title), '[a-z0-9]+') || ['__END__'] AS w FROM titles)"


@query("slot_context", f"WITH {_SLOTS} SELECT t, side, c, count(*) AS n FROM (SELECT w[i] AS t, 'left' AS side, w[i - 1] AS c FROM (SELECT w, unnest(range(2, len(w))) AS i FROM w) UNION ALL SELECT w[i], 'right', w[i + 1] FROM (SELECT w, unnest(range(2, len(w))) AS i FROM w)) GROUP BY 1, 2, 3")
def slot_context(spark, sf_dir):
    w = F.concat(F.array(F.lit("__START__")), F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit("__END__")))
    rows = titles(spark, sf_dir).select(w.alias("w")).select("w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("i"))
    both = F.array(F.struct(F.lit("left").alias("side"), F.element_at("w", F.col("i") - 1).alias("c")), F.struct(F.lit("right").alias("side"), F.element_at("w", F.col("i") + 1).alias("c")))
    return rows.select(F.element_at("w", F.col("i")).alias("t"), F.explode(both).alias("x")).groupBy("t", "x.side", "x.c").agg(F.count("*").alias("n"))


@query("slot_recover")
def slot_recover(spark, sf_dir):
    """Words of 1 to 3 % of the titles whose neighbours resemble those of a more frequent word."""
    ctx = slot_context(spark, sf_dir).withColumn("k", F.concat("side", F.lit(":"), "c")).select("t", "k", "n")
    total = ctx.groupBy("t").agg(F.sum("n").alias("total"))
    n = F.broadcast(titles(spark, sf_dir).agg(F.count("*").alias("titles")))
    share = total.crossJoin(n).withColumn("share", F.col("total") / (2 * F.col("titles")))
    rare, common = share.where("share BETWEEN 0.01 AND 0.03").select("t"), share.where("share > 0.03").select("t")
    a = ctx.join(rare, "t", "left_semi").withColumnsRenamed({"t": "a", "n": "x"})
    b = ctx.join(common, "t", "left_semi").withColumnsRenamed({"t": "b", "n": "y"})
    both = a.join(b, "k").groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("m"))
    both = both.join(total.select(F.col("t").alias("a"), F.col("total").alias("ta")), "a").join(total.select(F.col("t").alias("b"), F.col("total").alias("tb")), "b")
    s = both.withColumn("s", rnd(F.col("m") / (F.col("ta") + F.col("tb") - F.col("m")), 5)).where("s >= 0.2")
    return s.groupBy("a").agg(F.max_by("b", F.struct("s", "b")).alias("slot"), F.max("s").alias("s"))


@query("axis_regex_inject", "SELECT job_id, v, count(*) AS n FROM (SELECT job_id, nullif(regexp_extract(title, '([0-9]+)$', 1), '') AS v FROM titles) WHERE v IS NOT NULL AND NOT CAST(v AS INTEGER) BETWEEN 1990 AND 2034 GROUP BY 1, 2 HAVING n >= 3")
def axis_regex_inject(spark, sf_dir):
    v = F.nullif(F.regexp_extract("title", "([0-9]+)$", 1), F.lit(""))
    rows = titles(spark, sf_dir).select("job_id", v.alias("v")).where(F.col("v").isNotNull() & ~F.col("v").cast("int").between(1990, 2034))
    return rows.groupBy("job_id", "v").agg(F.count("*").alias("n")).where("n >= 3")


@query("community_score", f"WITH {_EXCL} SELECT sg.job_id, count(DISTINCT sg.g) AS members, round(coalesce(max(e.n), 0) / nullif(count(DISTINCT sg.g) * (count(DISTINCT sg.g) - 1) / 2.0::DOUBLE, 0), 5) AS density FROM sg LEFT JOIN (SELECT job_id, count(*) AS n FROM ex GROUP BY 1) e ON e.job_id = sg.job_id GROUP BY 1")
def community_score(spark, sf_dir):
    _, _, matches, sets = _parts(spark, sf_dir)
    e = T.exclusive_pairs(sets, T.pair_counts(matches), O).groupBy("job_id").agg(F.count("*").alias("n"))
    m = sets.groupBy("job_id").agg(F.count("*").alias("members"))
    return m.join(e, "job_id", "left").select("job_id", "members", rnd(F.coalesce("n", F.lit(0)) / F.nullif(F.col("members") * (F.col("members") - 1) / 2, F.lit(0.0)), 5).alias("density"))


@query("union_find", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 50 * 50 + p_partkey * 3 % 50 AS b FROM part), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, min(b) AS root FROM r GROUP BY 1")
def union_find(spark, sf_dir):
    """Components over one graph of all parts."""
    block = F.expr("p_partkey div 50")
    return components(M.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (block * 50 + F.col("p_partkey") * 3 % 50).alias("b")))


@query("cc_bfs")
def cc_bfs(spark, sf_dir):
    """Components of the n-grams of each job that occur together in most of their listings."""
    _, _, matches, sets = _parts(spark, sf_dir)
    size = sets.select("job_id", "g", "size")
    p = T.pair_counts(matches).join(size.withColumnsRenamed({"g": "a", "size": "na"}), ["job_id", "a"]).join(size.withColumnsRenamed({"g": "b", "size": "nb"}), ["job_id", "b"])
    near = p.where(F.col("common") / F.least("na", "nb") > 0.5)

    def one(key, pdf):
        nodes = sorted({*pdf.a, *pdf.b})
        at = {v: k for k, v in enumerate(nodes)}
        return pd.DataFrame({"job_id": key[0], "g": nodes, "component": T.union_find(len(nodes), [(at[a], at[b]) for a, b in zip(pdf.a, pdf.b)])})

    return near.groupBy("job_id").applyInPandas(one, "job_id bigint, g string, component bigint")


def _by_label(spark, sf_dir):
    """The vectors of each label, all of them."""
    return M.read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


@query("ward_linkage")
def ward_linkage(spark, sf_dir):
    def one(key, pdf):
        x = np.array(pdf.sort_values("vec_id").embedding.tolist(), float)
        return pd.DataFrame([(key[0], k, a, b, round(h, 4), n) for k, (a, b, h, n) in enumerate(G.ward(x))], columns=["label", "step", "a", "b", "height", "size"])

    return _by_label(spark, sf_dir).groupBy("label").applyInPandas(one, "label int, step bigint, a bigint, b bigint, height double, size bigint")


@query("ward_cut")
def ward_cut(spark, sf_dir):
    def one(key, pdf):
        pdf = pdf.sort_values("vec_id")
        x = np.array(pdf.embedding.tolist(), float)
        return pd.DataFrame({"label": key[0], "vec_id": pdf.vec_id, "cluster": G.cut(len(x), G.ward(x), 1.5)})

    return _by_label(spark, sf_dir).groupBy("label").applyInPandas(one, "label int, vec_id bigint, cluster bigint")


@query("cluster_text")
def cluster_text(spark, sf_dir):
    """Titles of a job, with their condition, clustered by TF-IDF and Ward; a hash picks the sample of a job that the clustering takes."""
    text = F.concat("title", F.lit(" ["), F.replace(F.coalesce("condition", F.lit("")), F.lit("_"), F.lit(" ")), F.lit("]"))
    k = F.row_number().over(Window.partitionBy("job_id").orderBy(F.xxhash64("listing_id", F.lit(42)), "listing_id"))
    rows = M.titles(spark, sf_dir).withColumn("k", k).where(F.col("k") <= G.MOST).select("job_id", "listing_id", text.alias("text"))
    terms = rows.select(F.concat_ws("|", "job_id", "listing_id").alias("doc"), "job_id", F.explode(X.ngrams(X.tfidf_tokens(F.col("text")))).alias("term"))
    w = V.tfidf(terms.select("doc", "term"))
    docs = w.join(terms.select("doc", "job_id").distinct(), "doc")

    def one(key, pdf):
        m = pdf.pivot_table(index="doc", columns="term", values="weight", fill_value=0.0).sort_index()
        x = m.to_numpy(float)
        return pd.DataFrame({"job_id": key[0], "doc": m.index, "cluster": G.cut(len(x), G.ward(x), max(1.5, 0.01 * len(x)))})

    return docs.groupBy("job_id").applyInPandas(one, "job_id bigint, doc string, cluster bigint")


@query("smp_farthest")
def smp_farthest(spark, sf_dir):
    def one(key, pdf):
        pdf = pdf.sort_values("vec_id").reset_index(drop=True)
        x = np.array(pdf.embedding.tolist(), float)
        return pd.DataFrame({"label": key[0], "vec_id": pdf.vec_id[G.farthest_points(x, 10)].to_numpy()})

    return _by_label(spark, sf_dir).groupBy("label").applyInPandas(one, "label int, vec_id bigint")


@query("scr_ngram_ward")
def scr_ngram_ward(spark, sf_dir):
    _, _, _, sets = _parts(spark, sf_dir)

    def one(key, pdf):
        grams = sorted(pdf.g)
        merges = G.ward(np.array([T.embed(g) for g in grams]))
        return pd.DataFrame([(key[0], t, len(set(G.cut(len(grams), merges, t)))) for t in (0.3, 0.5, 0.7, 1.0, 1.3)], columns=["job_id", "threshold", "clusters"])

    return sets.groupBy("job_id").applyInPandas(one, "job_id bigint, threshold double, clusters bigint")


_GRID = "(VALUES (50), (100), (150), (200)) d(divisor)"


@query("scr_param_sweep", f"WITH {_NG}, n AS (SELECT job_id, count(*) AS n FROM titles GROUP BY 1), df AS (SELECT job_id, g, count(DISTINCT listing_id) AS df FROM ng GROUP BY 1, 2) SELECT job_id, CAST(divisor AS BIGINT) AS divisor, count(*) FILTER (df >= CASE WHEN contains(g, ' ') THEN greatest(10, n // divisor) ELSE greatest(20, 2 * greatest(10, n // divisor)) END) AS kept FROM df JOIN n USING (job_id), {_GRID} GROUP BY 1, 2")
def scr_param_sweep(spark, sf_dir):
    t = T.distinct_titles(titles(spark, sf_dir))
    n = t.groupBy("job_id").agg(F.sum("weight").alias("n"))
    df = t.select("job_id", "weight", F.explode(F.array_distinct(X.ngrams(X.ngram_tokens(F.col("title"))))).alias("g")).groupBy("job_id", "g").agg(F.sum("weight").alias("df"))
    grid = F.explode(F.array(*(F.lit(d) for d in (50, 100, 150, 200))))
    rows = df.join(F.broadcast(n), "job_id").select("*", grid.alias("divisor")).withColumn("divisor", F.col("divisor").cast("bigint"))
    low = F.greatest(F.lit(10), F.expr("n div divisor"))
    return rows.groupBy("job_id", "divisor").agg(F.count_if(F.col("df") >= F.when(F.contains("g", F.lit(" ")), low).otherwise(F.greatest(F.lit(20), 2 * low))).alias("kept"))


@query("scr_axis_catalog", "SELECT axis, count(*) AS n FROM (VALUES ('Storage', '(?i)gb|tb'), ('Colour', '(?i)black|silver|gold'), ('Edition', '(?i)edition'), ('Size', '(?i)mm')) c(axis, p), pairs WHERE regexp_matches(a, p) GROUP BY 1")
def scr_axis_catalog(spark, sf_dir):
    catalog = spark.createDataFrame([("Storage", "(?i)gb|tb"), ("Colour", "(?i)black|silver|gold"), ("Edition", "(?i)edition"), ("Size", "(?i)mm")], "axis string, p string")
    return M.pairs(spark, sf_dir).crossJoin(F.broadcast(catalog)).where(F.expr("a rlike p")).groupBy("axis").agg(F.count("*").alias("n"))


@query("scr_job_select", "SELECT job_id, count(*) AS n FROM titles WHERE job_id NOT IN (1, 2, 3) GROUP BY 1 HAVING n > 100")
def scr_job_select(spark, sf_dir):
    known = spark.createDataFrame([(1,), (2,), (3,)], "job_id bigint")
    return titles(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n")).where("n > 100").join(known, "job_id", "left_anti")


@query("scr_null_normalise", "SELECT item_id, axis, CASE WHEN axis = 'a' THEN nullif(nullif(nullif(lower(trim(v)), 'none'), 'n/a'), '') END AS value FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN ' Red ' WHEN 1 THEN 'None' WHEN 2 THEN 'N/A' ELSE '' END AS v FROM benchmark), (VALUES ('a'), ('b')) x(axis)")
def scr_null_normalise(spark, sf_dir):
    k = F.col("item_id") % 4
    v = F.lower(F.trim(F.when(k == 0, " Red ").when(k == 1, "None").when(k == 2, "N/A").otherwise("")))
    rows = M.read(spark, sf_dir, "benchmark").select("item_id", F.lit("a").alias("axis"), F.when(~v.isin("null", "none", "n/a", ""), v).alias("value"))
    axes = spark.createDataFrame([("a",), ("b",)], "axis string")
    return rows.select("item_id").crossJoin(F.broadcast(axes)).join(rows, ["item_id", "axis"], "left")


@query("scr_pair_fetch", "SELECT pair_id, replace(a, chr(10), ' ') AS a, round(similarity, 4) AS similarity FROM pairs WHERE comparable AND job_id = 4 AND similarity <= 0.8 ORDER BY similarity, pair_id LIMIT 20")
def scr_pair_fetch(spark, sf_dir):
    rows = M.pairs(spark, sf_dir).where("comparable AND job_id = 4 AND similarity <= 0.8").orderBy("similarity", "pair_id").limit(20)
    return rows.select("pair_id", F.regexp_replace("a", "[\\r\\n]", " ").alias("a"), rnd("similarity").alias("similarity"))


@query("scr_flip_labels", "SELECT pair_id, CASE WHEN pair_id % 10 = 0 THEN NOT comparable ELSE comparable END AS label FROM pairs")
def scr_flip_labels(spark, sf_dir):
    rows = M.pairs(spark, sf_dir)
    fixes = rows.where("pair_id % 10 = 0").select("pair_id", (~F.col("comparable")).alias("fixed"))
    return rows.join(fixes, "pair_id", "left").select("pair_id", F.coalesce("fixed", "comparable").alias("label"))


@query("scr_price_regex_assign", "SELECT listing_id, CASE WHEN regexp_matches(title, '(?i)red') AND NOT regexp_matches(title, '(?i)large') THEN 'r' WHEN regexp_matches(title, '(?i)r') THEN 'any' END AS value FROM titles")
def scr_price_regex_assign(spark, sf_dir):
    rules = spark.createDataFrame([(1, "r", "(?i)red", "(?i)large"), (2, "any", "(?i)r", "^$")], "k int, value string, hit string, miss string")
    rows = titles(spark, sf_dir)
    found = rows.crossJoin(F.broadcast(rules)).where("title rlike hit AND NOT title rlike miss").groupBy("listing_id").agg(F.min_by("value", "k").alias("value"))
    return rows.select("listing_id").join(found, "listing_id", "left")


@query("scr_token_cost")
def scr_token_cost(spark, sf_dir):
    t = F.ceil(F.length("text") / 4)
    g = M.read(spark, sf_dir, "documents").agg(F.sum(t).alias("tokens"), F.min(t).alias("low"), F.max(t).alias("high"), F.avg(t).alias("mean"))
    return g.select("*", *(rnd(F.col("tokens") * price / 1e6, 6).alias(f"cost_{name}") for name, price in (("small", 0.15), ("large", 2.5))))


@query("scr_anchor_floor", "SELECT job_id, list_sort(list(price))[len(list(price)) // 10 + 1] IS NOT NULL AS has_floor, count(*) AS n FROM cells WHERE price > 0 GROUP BY 1 HAVING n >= 10")
def scr_anchor_floor(spark, sf_dir):
    g = M.cells(spark, sf_dir).where("price > 0").groupBy("job_id").agg(F.count("*").alias("n"), F.percentile_approx("price", 0.1).alias("floor")).where("n >= 10")
    return g.select("job_id", F.col("floor").isNotNull().alias("has_floor"), "n")


@query("scr_balanced")
def scr_balanced(spark, sf_dir):
    wrong = (V.ensemble_score(F.col("logit"), F.col("similarity")) > 0.5) != F.col("comparable")
    k = F.row_number().over(Window.partitionBy("wrong").orderBy(F.xxhash64("pair_id", F.lit(42)), "pair_id"))
    return M.pairs(spark, sf_dir).withColumn("wrong", wrong).withColumn("k", k).where("k <= 25").select("pair_id", "wrong")


@query("scr_strat_split")
def scr_strat_split(spark, sf_dir):
    w = Window.partitionBy("comparable")
    k = F.row_number().over(w.orderBy(F.xxhash64("pair_id", F.lit(42)), "pair_id"))
    return M.pairs(spark, sf_dir).select("pair_id", "comparable", F.when(k <= F.floor(F.count("*").over(w) * 0.9), "train").otherwise("test").alias("part"))


@query("scr_manual_pairs", "SELECT p.a AS anchor, p.b AS other, x.p_name AS name_a, y.p_name AS name_b FROM (VALUES (1, 2), (3, 4), (5, 99999999)) p(a, b) JOIN part x ON x.p_partkey = p.a JOIN part y ON y.p_partkey = p.b")
def scr_manual_pairs(spark, sf_dir):
    manual = spark.createDataFrame([(1, 2), (3, 4), (5, 99999999)], "anchor int, other int")
    part = M.read(spark, sf_dir, "part")
    a, b = part.select(F.col("p_partkey").alias("anchor"), F.col("p_name").alias("name_a")), part.select(F.col("p_partkey").alias("other"), F.col("p_name").alias("name_b"))
    return rounded(F.broadcast(manual).join(a, "anchor").join(b, "other").select(F.col("anchor").cast("int"), F.col("other").cast("int"), "name_a", "name_b"))


@query("scr_throughput")
def scr_throughput(spark, sf_dir):
    rows = spark.createDataFrame([(b, n, 0.004 * b + 0.0001 * n) for b in (16, 64, 128, 256) for n in (128, 256, 512)], "batch int, length int, seconds double")
    rate = F.col("batch") / F.col("seconds")
    return rows.select("batch", "length", rnd(rate).alias("pairs_per_s"), rnd(F.lit(26e6) / rate / 3600).alias("eta_h")).orderBy(F.desc("pairs_per_s"), "batch").limit(3)


@query("mine_pairs")
def mine_pairs(spark, sf_dir):
    from ..functions import labels as L

    diffs = F.size(L.fingerprint_diff(L.fingerprint(F.col("a")), L.fingerprint(F.col("b"))))
    rows = M.pairs(spark, sf_dir).where("comparable").withColumn("diffs", diffs).withColumn("label", (F.col("diffs") == 0).cast("bigint"))
    k = F.row_number().over(Window.partitionBy("job_id", "label").orderBy("diffs", "pair_id"))
    return rows.withColumn("k", k).where(F.col("k") <= F.when(F.col("label") == 0, 500).otherwise(200)).select("pair_id", "job_id", "label", "diffs")
