"""Sources, sinks, ingest, histories and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ingest as I
from ..operators import sampling as S
from ..operators import vectors as V
from ..registry import query
from ..sources import html as H
from ..sources import mapping as M
from ..sources.mapping import rnd
from ..store import folder
from .pricing_queries import rounded


#: Cards of a search page that `src_html_search` makes, about.
CARDS = 240


# ---- pages


@query("src_html_search")
def src_html_search(spark, sf_dir):
    """Search pages made from the listings, read back by the parser.

    A search of many listings is several pages of some `CARDS` cards with its page_id, however many listings there are.
    """
    rows = M.titles(spark, sf_dir).where("price IS NOT NULL")
    n = F.pmod(F.xxhash64("listing_id"), F.lit(89_999_999_999)) + 10_000_000_000
    parts = max(1, M.read(spark, sf_dir, "lineitem").count() // (997 * CARDS))
    keys = F.pmod(F.xxhash64("listing_id"), F.lit(997)).alias("page_id"), F.pmod(F.hash("listing_id"), F.lit(parts)).alias("part")
    found = rows.select(*keys, F.struct(n.alias("n"), "title", "price").alias("x")).groupBy("page_id", "part").agg(F.collect_list("x").alias("xs"))
    card = lambda x: F.concat(F.lit('<li class="s-card" data-viewport="1"><a class="s-card__link" href="https://x.example/itm/'), x["n"], F.lit('?x=1"><div class="s-card__title">New listing'), x["title"], F.lit('</div></a><span class="s-card__price">£'), F.format_string("%.2f", x["price"]), F.lit('</span><div class="s-card__subtitle-row">Pre-owned</div><span>+ £3.50 delivery</span></li>'))
    pages = found.select("page_id", F.concat(F.lit("<html><ul>"), F.array_join(F.transform("xs", card), ""), F.lit("</ul></html>")).alias("html"))
    return H.search_listings(pages)


@query("src_html_item")
def src_html_item(spark, sf_dir):
    return H.item_listings(M.read(spark, sf_dir, "pages"))


@query("src_html_desc")
def src_html_desc(spark, sf_dir):
    return M.read(spark, sf_dir, "pages").select("page_id", H.clean_description("html").alias("text"))


@query("str_clean")
def str_clean(spark, sf_dir):
    t = H.clean_description("html")
    return M.read(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("str_catalog_page", "SELECT page_id, regexp_matches(html, '<link[^>]+rel=\"canonical\"[^>]+/p/') AS is_catalog FROM pages")
def str_catalog_page(spark, sf_dir):
    return M.read(spark, sf_dir, "pages").select("page_id", F.col("html").rlike('<link[^>]+rel="canonical"[^>]+/p/').alias("is_catalog"))


@query("str_evidence")
def str_evidence(spark, sf_dir):
    """Whether the colour of a cell is evidenced in its title: as it stands, without blanks, or as a stem."""
    rows = M.cells(spark, sf_dir)
    t, v = F.lower("title"), F.lower("colour")
    squeezed = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    found = F.when(F.contains(t, v), "exact").when(F.contains(squeezed(t), squeezed(v)), "squeezed").when(F.exists(X.tokens(F.col("title")), lambda w: X.stem_variants(w, v)), "stem").otherwise("none")
    return rows.groupBy(found.alias("evidence")).agg(F.count("*").alias("n"))


# ---- files


@query("src_csv", "SELECT item_id, text FROM benchmark")
def src_csv(spark, sf_dir):
    path = folder(spark, "csv")
    I.write_csv(M.read(spark, sf_dir, "benchmark").select("item_id", "text"), path)
    return I.read_csv(spark, path, "item_id bigint, text string")


@query("snk_csv", "SELECT pair_id, a, b FROM pairs")
def snk_csv(spark, sf_dir):
    path = folder(spark, "csv")
    I.write_csv(M.pairs(spark, sf_dir).select("pair_id", "a", "b"), path)
    return I.read_csv(spark, path, "pair_id bigint, a string, b string")


@query("src_jsonl", "SELECT 'pair-' || pair_id AS id, pair_id AS index, CASE WHEN pair_id % 5 > 0 THEN CASE WHEN comparable THEN 'same' ELSE 'different' END END AS verdict, CASE WHEN pair_id % 5 > 0 THEN description END AS reason, CASE WHEN pair_id % 5 = 0 THEN 'rate limit' END AS error FROM pairs")
def src_jsonl(spark, sf_dir):
    c = F.to_json(F.struct(F.when(F.col("comparable"), "same").otherwise("different").alias("verdict"), F.col("description").alias("reason")))
    ok = F.col("pair_id") % 5 > 0
    body = F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("message"))).alias("choices"))
    line = F.struct(F.concat(F.lit("pair-"), F.col("pair_id")).alias("custom_id"), F.when(ok, F.struct(F.lit(200).alias("status_code"), body.alias("body"))).alias("response"), F.when(~ok, F.struct(F.lit("rate limit").alias("message"))).alias("error"))
    return I.batch_output(M.pairs(spark, sf_dir).select(F.to_json(line).alias("value")))


@query("snk_jsonl", "SELECT pair_id, a FROM pairs")
def snk_jsonl(spark, sf_dir):
    path = folder(spark, "jsonl")
    I.write_jsonl(M.pairs(spark, sf_dir).select("pair_id", "a"), path, 50)
    return spark.read.schema("pair_id bigint, a string").json(path)


@query("snk_replace", "SELECT status, count(*) AS n FROM listings GROUP BY 1")
def snk_replace(spark, sf_dir):
    path = folder(spark, "table")
    counts = M.listings(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    I.replace_table(counts.withColumn("n", F.lit(0).cast("bigint")), path)
    return I.replace_table(counts, path)


@query("snk_replace_key", "SELECT part_id, CASE WHEN job_id = 3 THEN 0 ELSE count(*) END AS n, job_id FROM listings GROUP BY 1, job_id")
def snk_replace_key(spark, sf_dir):
    path = folder(spark, "table")
    counts = M.listings(spark, sf_dir).groupBy("part_id", "job_id").agg(F.count("*").alias("n"))
    I.replace_keys(counts, path, "job_id")
    out = I.replace_keys(counts.where("job_id = 3").withColumn("n", F.lit(0).cast("bigint")), path, "job_id")
    return out.select("part_id", "n", F.col("job_id").cast("bigint").alias("job_id"))


_DELTA = "SELECT listing_id, job_id, CASE WHEN part_id % 2 = 0 THEN 'Sold' ELSE 'Active' END AS status, price * 2 AS price FROM listings WHERE part_id % 3 = 0 UNION ALL SELECT 'new-' || p_partkey, 1, 'Active', p_retailprice FROM part WHERE p_partkey < 10"
_RANK = "CASE {0} WHEN 'Active' THEN 0 WHEN 'OutOfStock' THEN 1 WHEN 'Ended' THEN 2 WHEN 'Sold' THEN 3 ELSE -1 END"


def _delta(spark, sf_dir):
    rows = M.listings(spark, sf_dir).where("part_id % 3 = 0")
    status = F.when(F.col("part_id") % 2 == 0, "Sold").otherwise("Active")
    new = M.read(spark, sf_dir, "part").where("p_partkey < 10").select(F.concat(F.lit("new-"), "p_partkey").alias("listing_id"), F.lit(1).cast("bigint").alias("job_id"), F.lit("Active").alias("status"), F.col("p_retailprice").alias("price"))
    return rows.select("listing_id", "job_id", status.alias("status"), (F.col("price") * 2).alias("price")).unionByName(new)


@query("snk_upsert", f"WITH d AS ({_DELTA}) SELECT coalesce(l.listing_id, d.listing_id) AS listing_id, CASE WHEN l.listing_id IS NULL OR (d.listing_id IS NOT NULL AND {_RANK.format('d.status')} >= {_RANK.format('l.status')}) THEN d.status ELSE l.status END AS status, round(CASE WHEN l.listing_id IS NULL OR (d.listing_id IS NOT NULL AND {_RANK.format('d.status')} >= {_RANK.format('l.status')}) THEN d.price ELSE l.price END, 3) AS price FROM listings l FULL JOIN d ON l.listing_id = d.listing_id")
def snk_upsert(spark, sf_dir):
    out = I.upsert(M.listings(spark, sf_dir).select("listing_id", "job_id", "status", "price"), _delta(spark, sf_dir))
    return out.select("listing_id", "status", rnd("price", 3).alias("price"))


@query("snk_update_batch", "SELECT pair_id, round(CASE WHEN pair_id % 4 = 0 THEN 0.5 ELSE similarity END, 4) AS similarity FROM pairs")
def snk_update_batch(spark, sf_dir):
    rows = M.pairs(spark, sf_dir).select("pair_id", "similarity")
    return rounded(I.update_batch(rows, rows.where("pair_id % 4 = 0").withColumn("similarity", F.lit(0.5)), "pair_id", "similarity"))


@query("snk_delete", "SELECT listing_id FROM listings WHERE NOT (title IS NULL OR price IS NULL)")
def snk_delete(spark, sf_dir):
    return M.listings(spark, sf_dir).where("NOT (title IS NULL OR price IS NULL)").select("listing_id")


@query("snk_index", "SELECT vec_id AS id, vec_id % 3 <> 0 AND vec_id < 400 AS found FROM embeddings")
def snk_index(spark, sf_dir):
    v = M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    path = folder(spark, "index")
    I.Index(v.where("id < 300")).upsert(v.where("id BETWEEN 200 AND 399")).remove(v.where("id % 3 = 0").select("id")).save(path)
    return I.Index.load(spark, path).contains(v.select("id"))


@query("src_reindex_missing", "SELECT listing_id, length(left(concat_ws(' ', title, description), 6000)) AS chars FROM listings WHERE part_id % 2 = 1 AND trim(concat_ws(' ', title, description)) <> ''")
def src_reindex_missing(spark, sf_dir):
    rows = M.listings(spark, sf_dir)
    index = rows.where("part_id % 2 = 0").select("listing_id")
    text = F.substring(X.embed_text(F.col("title"), F.col("description")), 1, 6000)
    return rows.join(index, "listing_id", "left_anti").where(F.trim(text) != "").select("listing_id", F.length(text).cast("bigint").alias("chars"))


# ---- ingest


@query("jn_sold_wins", "SELECT listing_id, status FROM (SELECT listing_id, 'Sold' AS status FROM listings WHERE status = 'Sold' UNION ALL SELECT listing_id, 'Active' FROM listings WHERE status <> 'Sold')")
def jn_sold_wins(spark, sf_dir):
    rows = M.listings(spark, sf_dir).select("listing_id", "price", "status")
    out = I.sold_wins(rows.withColumn("status", F.lit("Active")), rows.where("status = 'Sold'"))
    return out.select("listing_id", "status")


_SUMM = "SELECT listing_id, CASE WHEN part_id % 4 = 0 THEN job_id + 1 ELSE job_id END AS job_id, CASE WHEN part_id % 2 = 0 THEN 'Sold' ELSE 'Active' END AS status FROM listings WHERE part_id % 3 = 0"
_KIND = "CASE WHEN l.status IS NULL THEN 'new' WHEN l.job_id <> s.job_id THEN 'cross_job' WHEN l.status IN ('Sold', 'Ended') THEN 'terminal' WHEN s.status = 'Sold' THEN 'sold' ELSE 'update' END"


def _summaries(spark, sf_dir):
    rows = M.listings(spark, sf_dir).where("part_id % 3 = 0")
    return rows.select("listing_id", F.when(F.col("part_id") % 4 == 0, F.col("job_id") + 1).otherwise(F.col("job_id")).alias("job_id"), F.when(F.col("part_id") % 2 == 0, "Sold").otherwise("Active").alias("status"))


@query("jn_classify", f"WITH s AS ({_SUMM}) SELECT s.listing_id, {_KIND} AS kind FROM s LEFT JOIN (SELECT * FROM listings WHERE part_id % 5 > 0) l ON l.listing_id = s.listing_id")
def jn_classify(spark, sf_dir):
    return I.classified(_summaries(spark, sf_dir), M.listings(spark, sf_dir).where("part_id % 5 > 0")).select("listing_id", "kind")


@query("jn_transition", f"WITH s AS ({_SUMM}) SELECT count(*) AS n FROM s JOIN listings l ON l.listing_id = s.listing_id WHERE s.status = 'Sold' AND l.status = 'Active'")
def jn_transition(spark, sf_dir):
    live = M.listings(spark, sf_dir).where("status = 'Active'").select("listing_id")
    return _summaries(spark, sf_dir).where("status = 'Sold'").join(live, "listing_id").agg(F.count("*").alias("n"))


@query("jn_merge_labels", "SELECT p.pair_id, coalesce(CASE WHEN p.pair_id % 5 > 0 THEN CASE WHEN comparable THEN 'same' ELSE 'different' END END, 'unlabelled') AS verdict FROM pairs p")
def jn_merge_labels(spark, sf_dir):
    verdicts = src_jsonl(spark, sf_dir).where("error IS NULL").select(F.col("index").alias("pair_id"), "verdict")
    return M.pairs(spark, sf_dir).select("pair_id").join(verdicts, "pair_id", "left").select("pair_id", F.coalesce("verdict", F.lit("unlabelled")).alias("verdict"))


@query("jn_refresh", "SELECT pair_id, coalesce(x.p_name, a) AS a, coalesce(y.p_name, b) AS b FROM pairs LEFT JOIN part x ON x.p_partkey = pair_id + 150 LEFT JOIN part y ON y.p_partkey = pair_id * 2")
def jn_refresh(spark, sf_dir):
    names = M.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    x, y = names.withColumnsRenamed({"k": "ka", "p_name": "na"}), names.withColumnsRenamed({"k": "kb", "p_name": "nb"})
    p = M.pairs(spark, sf_dir)
    return p.join(x, F.col("ka") == F.col("pair_id") + 150, "left").join(y, F.col("kb") == F.col("pair_id") * 2, "left").select("pair_id", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))


_LAG = "(SELECT *, lag({0}) OVER w AS before, row_number() OVER w AS k FROM history WINDOW w AS (PARTITION BY listing ORDER BY recorded, history_id))"


@query("inc_price_history", f"SELECT history_id, listing, price FROM {_LAG.format('price')} WHERE k = 1 OR before IS DISTINCT FROM price")
def inc_price_history(spark, sf_dir):
    return I.changes(M.history(spark, sf_dir), "price").select("history_id", "listing", "price")


@query("inc_status_history", f"SELECT history_id, listing, before AS old_status, status FROM {_LAG.format('status')} WHERE k = 1 OR before IS DISTINCT FROM status")
def inc_status_history(spark, sf_dir):
    return I.changes(M.history(spark, sf_dir), "status").select("history_id", "listing", F.col("before").alias("old_status"), "status")


@query("inc_initial_history", f"SELECT listing, history_id, 'InitialScrape' AS source FROM {_LAG.format('status')} WHERE k = 1")
def inc_initial_history(spark, sf_dir):
    return I.changes(M.history(spark, sf_dir), "status").where("initial").select("listing", "history_id", F.lit("InitialScrape").alias("source"))


@query("inc_status_refresh", f"WITH s AS ({_SUMM}) SELECT l.listing_id, l.status AS old_status, s.status FROM s JOIN listings l ON l.listing_id = s.listing_id WHERE l.status <> s.status")
def inc_status_refresh(spark, sf_dir):
    old = M.listings(spark, sf_dir).select("listing_id", F.col("status").alias("old_status"))
    return _summaries(spark, sf_dir).join(old, "listing_id").where("status <> old_status").select("listing_id", "old_status", "status")


@query("inc_resume", "SELECT run_id FROM runs WHERE run_id > 300 AND status NOT IN ('Completed', 'Failed')")
def inc_resume(spark, sf_dir):
    return M.runs(spark, sf_dir).where("run_id > 300 AND status NOT IN ('Completed', 'Failed')").select("run_id")


@query("inc_recovery", "SELECT batch_id, count(*) AS open, min(run_id) AS first FROM runs WHERE status IN ('Running', 'Queued') GROUP BY 1")
def inc_recovery(spark, sf_dir):
    return M.runs(spark, sf_dir).where("status IN ('Running', 'Queued')").groupBy("batch_id").agg(F.count("*").alias("open"), F.min("run_id").alias("first"))


@query("inc_desc_status", "SELECT CASE WHEN part_id % 7 = 0 THEN 'failed' WHEN title IS NULL THEN 'missing' ELSE 'complete' END AS status, count(*) AS n FROM listings GROUP BY 1")
def inc_desc_status(spark, sf_dir):
    s = I.description_status(F.col("part_id") % 7 != 0, F.col("title"))
    return M.listings(spark, sf_dir).groupBy(s.alias("status")).agg(F.count("*").alias("n"))


#: Slices of time in which the streams below get the events, and files of a slice.
SLICES, FILES = 4, 2


def _streamed(spark, sf_dir, build, name: str, twice: bool = False):
    """Runs a stream over the events to its end, a slice of time for each micro-batch, and returns what it wrote.

    A slice's files hold its rows in no order. The last micro-batch is a heartbeat long after the last event, with
    which everything that waits for the watermark comes out.
    """
    path = folder(spark, name)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("recorded").cast("timestamp_ntz"))
    src = M.history(spark, sf_dir).withColumn("recorded", F.timestamp_micros(micros))
    low, high = src.agg(F.min(F.unix_micros("recorded")), F.max(F.unix_micros("recorded"))).first()
    for k in range(SLICES if low is not None else 0):
        at = F.floor((F.unix_micros("recorded") - low) * SLICES / F.lit(float(max(1, high - low))))
        part = src.where(F.least(at, F.lit(SLICES - 1)) == k)
        (part.unionByName(part) if twice else part).repartition(FILES).write.mode("append").parquet(f"{path}/in")
    beat = spark.range(1).select(*(F.lit(None).cast(kind).alias(c) for c, kind in src.dtypes if c != "recorded"), F.timestamp_micros(F.lit(high or 0) + 10**13).alias("recorded"))
    beat.select(*src.columns).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in")
    out = build(stream)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("inc_status_stream", f"SELECT history_id, listing, before AS old_status, status FROM {_LAG.format('status')} WHERE k = 1 OR before IS DISTINCT FROM status")
def inc_status_stream(spark, sf_dir):
    from ..streaming.status import status_changes

    return _streamed(spark, sf_dir, status_changes, "status")


@query("inc_backpressure", "SELECT CAST(recorded AS DATE) AS day, status, count(*) AS n FROM history GROUP BY 1, 2")
def inc_backpressure(spark, sf_dir):
    from ..streaming.status import counts_by_window

    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("start") / 86_400_000_000).cast("int"))
    return _streamed(spark, sf_dir, counts_by_window, "counts").select(day.alias("day"), "status", "n")


@query("inc_dedupe_stream", "SELECT history_id, listing, status FROM history")
def inc_dedupe_stream(spark, sf_dir):
    """Every event is sent twice."""
    from ..streaming.status import deduplicated

    return _streamed(spark, sf_dir, deduplicated, "dedupe", twice=True).select("history_id", "listing", "status")


# ---- samples


@query("smp_random")
def smp_random(spark, sf_dir):
    return S.random_rows(M.listings(spark, sf_dir).select("listing_id", "job_id"), "listing_id", 100)


@query("smp_even", "SELECT listing_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY listing_id) - 1 AS k, count(*) OVER (PARTITION BY job_id) AS n FROM listings) WHERE n <= 25 OR k IN (SELECT CAST(floor(i * n / 25.0::DOUBLE) AS BIGINT) FROM (SELECT unnest(range(25)) AS i))")
def smp_even(spark, sf_dir):
    return S.evenly(M.listings(spark, sf_dir).select("listing_id", "job_id"), ["job_id"], "listing_id", 25)


@query("smp_price", "SELECT listing_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY price, listing_id) - 1 AS k, count(*) OVER (PARTITION BY job_id) AS n FROM listings WHERE price IS NOT NULL) WHERE k IN (SELECT CAST(floor(i * (n - 1) / 9.0::DOUBLE) AS BIGINT) FROM (SELECT unnest(range(10)) AS i))")
def smp_price(spark, sf_dir):
    return S.by_price(M.listings(spark, sf_dir).where("price IS NOT NULL").select("listing_id", "job_id", "price"), ["job_id"], 10).select("listing_id", "job_id")


@query("smp_tiers")
def smp_tiers(spark, sf_dir):
    p = M.pairs(spark, sf_dir).select("pair_id", "similarity")
    tiers = [("hard", "similarity BETWEEN 0.4 AND 0.6"), ("high", "similarity > 0.8"), ("low", "similarity < 0.2")]
    parts = [S.random_rows(p.where(w), "pair_id", 20).withColumn("tier", F.lit(t)) for t, w in tiers]
    return parts[0].union(parts[1]).union(parts[2]).dropDuplicates(["pair_id"])


@query("smp_banded")
def smp_banded(spark, sf_dir):
    v = M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    hits = V.knn(v, v.where("id % 100 = 0"), 50, drop_self=True)
    band = F.when(F.col("score") >= 0.3, "a").when(F.col("score") >= 0.2, "b").when(F.col("score") >= 0.1, "c")
    return S.per_group(hits.withColumn("band", band).where("band IS NOT NULL"), ["query", "band"], "id", 2).select("query", "id", "band")


@query("smp_cross")
def smp_cross(spark, sf_dir):
    e = M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    hits = V.knn(e, e.where("id % 100 = 0"), 50, drop_self=True)
    own = e.select(F.col("id").alias("query"), F.col("label").alias("own"))
    return hits.join(e.select("id", "label"), "id").join(own, "query").where("label <> own").withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where("k <= 3").select("query", "id", F.lit(0).alias("y"))


@query("smp_random_same")
def smp_random_same(spark, sf_dir):
    """Pairs of neighbours in a hash order of each job, not yet linked by an edge."""
    w = Window.partitionBy("job_id").orderBy(S.draw("listing_id"), "listing_id")
    rows = M.listings(spark, sf_dir).select("job_id", F.col("listing_id").alias("a"), F.lead("listing_id").over(w).alias("b"), F.row_number().over(w).alias("k")).where("b IS NOT NULL AND k <= 50")
    pairs = rows.select("job_id", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    return pairs.join(M.edges(spark, sf_dir).select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")


@query("smp_desc_overlap", "SELECT d, count(*) AS n, count(DISTINCT job_id) AS jobs FROM (SELECT lower(trim(left(description, 80))) AS d, job_id FROM listings WHERE length(description) >= 18) GROUP BY 1 HAVING n > 1")
def smp_desc_overlap(spark, sf_dir):
    d = F.lower(F.trim(F.substring("description", 1, 80)))
    rows = M.listings(spark, sf_dir).where("length(description) >= 18").select(d.alias("d"), "job_id")
    return rows.groupBy("d").agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("jobs")).where("n > 1")


@query("smp_split")
def smp_split(spark, sf_dir):
    return S.split(M.pairs(spark, sf_dir).select("pair_id", "job_id", "comparable"), ["job_id", "comparable"], "pair_id", {"train": 0.8, "dev": 0.1, "test": 0.1})


@query("smp_swap", "SELECT pair_id, a, b FROM pairs UNION ALL SELECT pair_id, b, a FROM pairs")
def smp_swap(spark, sf_dir):
    p = M.pairs(spark, sf_dir)
    return p.select("pair_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("pair_id", "x.a", "x.b")


@query("smp_oversample", "SELECT pair_id, count(*) AS n FROM (SELECT DISTINCT pair_id, a, b FROM (SELECT pair_id, a, b, unnest(range(CASE WHEN pair_id % 10 = 0 THEN 5 ELSE 1 END)) FROM pairs)) GROUP BY 1")
def smp_oversample(spark, sf_dir):
    times = F.when(F.col("pair_id") % 10 == 0, 5).otherwise(1)
    rows = M.pairs(spark, sf_dir).select("pair_id", "a", "b", F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")
    return rows.dropDuplicates(["pair_id", "a", "b"]).groupBy("pair_id").agg(F.count("*").alias("n"))
