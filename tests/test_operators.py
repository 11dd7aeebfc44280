"""Literal cases of the operators, and twins for what SQL can't express."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stallwright.functions import labels as L
from stallwright.functions import text as X
from stallwright.operators import cells, clustering, ingest, market, pricing, sampling, taxonomy, vectors
from stallwright.sources import html
from stallwright.sources.mapping import as_of


def comps(spark, prices, **k):
    rows = [("a", f"s{i}", k.get("ask", 100.0), None, 1, "NEW", "NEW", float(p), None, None, 0.8, c) for i, (p, c) in enumerate(zip(prices, k.get("conf", [0.9] * len(prices))))]
    return spark.createDataFrame(rows, "active_id string, sold_id string, ask double, shipping double, job_id bigint, a_condition string, s_condition string, sold_price double, created timestamp_ntz, ended timestamp_ntz, similarity double, confidence double")


@pytest.mark.parametrize(
    ("prices", "kept"),
    [([50, 55, 60, 65, 200], 4), ([50, 55, 200], 3), ([100] * 4, 4), ([1, 50, 55, 60, 65, 200], 4)],
)
def test_outliers(spark, prices, kept):
    assert pricing.without_outliers(pricing.quartiles(comps(spark, prices))).count() == kept


def test_predictions(spark):
    p = pricing.predictions(comps(spark, [40, 50, 60, 70, 80], ask=10.0), as_of()).first()
    assert (p.n, p.median_price, p.outliers_removed) == (5, 60.0, 0)
    mean = pricing.predictions(comps(spark, [100, 100, 200], conf=[0.99, 0.99, 0.5], ask=1.0), as_of()).first().mean_price
    assert mean < 150


def test_cell_profit(spark):
    rows = [(1, "k", t, float(p), s, not s) for t, p, s in [("a", 150, True), ("b", 200, True), ("c", 250, True), ("d", 100, False)]]
    df = spark.createDataFrame(rows, "job_id bigint, cell_key string, title string, price double, is_sold boolean, is_active boolean")
    r = cells.opportunities(df, ["job_id", "cell_key"]).collect()
    assert len(r) == 1 and r[0].profit == pytest.approx(73.5)


def test_cell_key(spark):
    key = cells.cell_key(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.lit("NEW"))
    assert spark.range(1).select(key.alias("k")).first().k == "a=1 | b=2 | condition=NEW"


def test_communities_and_components():
    assert taxonomy.louvain(6, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)]) == [0, 0, 0, 1, 1, 1]
    assert taxonomy.louvain(3, []) == [0, 1, 2]
    assert taxonomy.union_find(5, [(3, 1), (1, 4)]) == [0, 1, 2, 1, 1]


def test_ward_cut():
    x = np.array([[0, 0], [0.1, 0], [10, 0], [10.1, 0]])
    assert clustering.cut(4, clustering.ward(x), 2) == [0, 0, 1, 1]
    assert clustering.ward(x[:1]) == [] and clustering.cut(0, [], 1) == []
    assert clustering.farthest_points(x, 2) == [0, 3]


def test_axis_steps():
    s = taxonomy.Overlaps({"red": 50, "blue": 40, "crimson": 45, "with": 30}, {("crimson", "red"): 44})
    assert taxonomy.drop_generic([["red", "with", "blue"]]) == [["red", "blue"]]
    assert taxonomy.dedupe_overlap([["red", "crimson", "blue"]], s) == [["red", "blue"]]
    assert taxonomy.prune_overlap([["red", "crimson", "blue"]], s) == [["red", "blue"]]
    assert taxonomy.enforce_exclusive([["crimson", "red", "blue"]], s) == [["red", "blue"]]
    assert taxonomy.validated([["red", "crimson"]], s) == []
    assert taxonomy.dedupe_embed([["seal", "sealed", "open"]]) == [["seal", "open"]]
    assert taxonomy.refine({"A": ["x"], "B": ["y"]}, {"x": 50}, 100, {"merge": {"A": ["B"]}, "remove": {"A": ["x", "y"]}}) == {"A": ["x"]}
    assert [g for g, _ in taxonomy.merge_synonyms(["128gb", "256gb", "controller", "controllers"], [9, 8, 7, 6])] == ["128gb", "256gb", "controller"]


def test_steps_on_axes_without_values():
    assert taxonomy.drop_outliers([[], ["red"]]) == []
    assert taxonomy.drop_outliers([["red", "red ring"], []]) == [["red", "red ring"]]


def test_a_job_without_significant_sets_reaches_no_step(spark):
    sets = spark.createDataFrame([(1, "red", 5), (1, "blue", 4)], "job_id bigint, g string, size bigint")
    pairs = spark.createDataFrame([(1, "blue", "red", 2), (1, "blue", "rare", 1), (2, "x", "y", 3)], "job_id bigint, a string, b string, common bigint")

    def one(key, values, common):
        return pd.DataFrame({"job_id": [key[0]], "sets": [len(values)], "pairs": [len(common)]})

    rows = taxonomy.by_job(sets, pairs).applyInPandas(one, "job_id bigint, sets bigint, pairs bigint").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 1)]


def test_taxonomy_finds_an_axis(spark):
    r = random.Random(1)
    colours, sizes = ["crimsonish", "crimsonite", "crimsonoid", "crimsonfold"], ["bigsize seventeen", "bigsize twentyfour", "bigsize thirtyone", "bigsize ninetyfive"]
    rows = [(1, f"l{k}", f"{r.choice(colours)} q{k}q {r.choice(sizes)}") for k in range(400)]
    t = spark.createDataFrame(rows, "job_id bigint, listing_id string, title string")
    axes, assigned = taxonomy.run(t)
    found = {}
    for a in axes.collect():
        found.setdefault(a.axis, set()).add(a.label)
    assert set(colours) in found.values()
    one = assigned.where("listing_id = 'l0'").first()
    assert rows[0][2].split()[0] in one.cell.values() and not one.has_conflict


def test_synonyms_and_absorbed_ngrams_keep_their_forms():
    groups = taxonomy.synonym_groups(["wireless pad", "wireless pads", "128gb", "256gb"], [5, 9, 3, 2])
    assert ("wireless pads", 14, ["wireless pad", "wireless pads"]) in groups and len(groups) == 3  # numeric variants stay apart
    out = taxonomy.subsumed([("gold plated", 9, ["gold plated"]), ("gold plated x", 4, ["gold plated x"]), ("gold", 20, ["gold"])], threshold=0.7)
    assert out == [("gold", 20, ["gold"]), ("gold plated", 13, ["gold plated", "gold plated x"])]


def test_no_synonyms_among_no_ngrams():
    assert taxonomy.synonym_groups([], []) == [] and taxonomy.merge_synonyms([], []) == []


def test_synonym_merge_takes_every_kept_ngram_and_keeps_frequencies_and_forms(spark, monkeypatch):
    from stallwright.plans import all_queries, taxonomy_queries

    def rows(n, title):
        return [(1, f"{title} {k}", title) for k in range(n)]

    # 1000 titles: 20 with "controller" are below the 3 % of match sets, and "gadget" is always in a longer n-gram
    t = spark.createDataFrame(rows(930, "gadget gizmo") + rows(20, "controller") + rows(12, "controllern") + rows(38, "128gb"), "job_id bigint, listing_id string, title string")
    monkeypatch.setattr(taxonomy_queries, "titles", lambda spark, sf_dir: t)
    got = all_queries()[0]["synonym_merge"](spark, "").collect()
    assert sorted(map(tuple, got)) == [
        (1, "128gb", 38, ["128gb"]),
        (1, "controller", 32, ["controller", "controllern"]),
        (1, "gadget", 930, ["gadget"]),
        (1, "gadget gizmo", 930, ["gadget gizmo"]),
        (1, "gizmo", 930, ["gizmo"]),
    ]


def test_synonyms_by_any_embedding():
    known = {"playstation 5": [1, 0, 0], "ps5": [0.995, 0.0998, 0], "digital": [0, 0, 1]}
    groups = taxonomy.synonym_groups(list(known), [100, 200, 50], embedding=lambda g: np.array(known[g]))
    assert groups == [("ps5", 300, ["playstation 5", "ps5"]), ("digital", 50, ["digital"])]
    # transitive, and beyond a block of rows
    far = taxonomy.synonym_groups([f"w{'x' * k}" for k in range(2500)], [1] * 2500, embedding=lambda g: np.array([np.cos(len(g) / 5), np.sin(len(g) / 5)]))
    assert len(far) == 1 and far[0][1] == 2500 == len(far[0][2])


def test_a_cosine_of_just_the_threshold_is_similar():
    e = np.zeros((2, 10))
    e[0, :5], e[1, 1:6] = 1, 1
    at = dict(zip(("a", "b"), e / np.sqrt(5)))
    assert at["a"] @ at["b"] < 0.8  # 4 / 5, rounded down
    assert taxonomy.synonym_groups(["a", "b"], [2, 1], embedding=at.get) == [("a", 3, ["a", "b"])]


def test_search_term_and_decontamination(spark):
    rows = [(1, f"l{k}", "acme pad red" if k % 2 else "acme pad blue", "acme pad") for k in range(60)] + [(1, "x", "other thing", "acme pad")]
    t = spark.createDataFrame(rows, "job_id bigint, listing_id string, title string, search_term string")
    kept, _ = taxonomy.extract_ngrams(taxonomy.distinct_titles(t))
    assert {r.g for r in kept.collect()} == {"red", "blue"}
    stay = taxonomy.decontaminated(t, ("acme",), taxonomy.TaxonomyOptions(title_cosine=0.3))
    assert stay.columns == t.columns and sorted(r.listing_id for r in stay.collect()) == sorted(f"l{k}" for k in range(60))


def test_components_of_one_graph(spark):
    from stallwright.operators.graph import components

    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (60, 60), (51, 40)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 51: 40, 60: 60}
    assert components(links.limit(0)).count() == 0


def test_replace_keeps_the_old_table_when_the_write_fails(spark, tmp_path):
    from pyspark.sql import functions as F

    from stallwright.operators import ingest

    path = f"file://{tmp_path}/table"
    ingest.replace_table(spark.range(3), path)
    again = ingest.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)  # reads the old one
    assert sorted(r.id for r in again.collect()) == [10, 11, 12]
    with pytest.raises(Exception, match="broken"):
        ingest.replace_table(spark.range(3).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id")), path)
    assert spark.read.parquet(path).count() == 3


def test_index_upsert_keeps_one_row_of_an_id(spark):
    from stallwright.operators import ingest

    old = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id bigint, v array<double>")
    new = spark.createDataFrame([(2, [3.0]), (4, [1.0]), (4, [5.0]), (4, [5.0])], "id bigint, v array<double>")
    assert {r.id: r.v for r in ingest.Index(old).upsert(new).rows.collect()} == {1: [1.0], 2: [3.0], 4: [5.0]}
    assert ingest.Index(old).upsert(new).rows.count() == 3


def test_predictions_in_a_price_band(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from stallwright.operators import pricing

    prices = [40.0, 50.0, 60.0, 100.0, 110.0, 120.0]
    rows = [("a", f"s{k}", 45.0, 0.0, 1, "NEW", "NEW", p, datetime(2020, 1, 1), datetime(2020, 1, 11), 0.9, 0.9) for k, p in enumerate(prices)]
    comps = spark.createDataFrame(rows, "active_id string, sold_id string, ask double, shipping double, job_id bigint, a_condition string, s_condition string, sold_price double, created timestamp, ended timestamp, similarity double, confidence double")
    one = pricing.predictions(comps, F.lit(datetime(2020, 1, 11)), pricing.PricingOptions(price_band=2.0, fee_percent=0)).first()
    assert one.n == 3 and one.outliers_removed == 3 and abs(one.mean_price - 50) < 1e-9 and one.median_price == 80 and one.days_to_sell == 10
    assert pricing.predictions(comps, F.lit(datetime(2020, 1, 11))).first().n == 6


def test_knn_equals_brute_force_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(60, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: [int(i) for i in np.argsort(-np.round(u @ u[q], 12), kind="stable") if i != q][:4] for q in range(0, 60, 10)}
    for block in (2, 4096):
        got = {}
        for r in vectors.knn(df, df.where("id % 10 = 0"), 4, block, drop_self=True).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.id)
        assert got == want


def _all_pairs(rows, k, floor, digits, nudge):
    """The first k pairs as DuckDB's rule gives them, one by one."""
    found = []
    for i, (a, v, label) in enumerate(rows):
        for b, w, other in rows[i + 1 :]:
            if label is None or label != other or a == b or len(v) != len(w) or not v or None in v or None in w:
                continue
            dot = n = m = 0.0
            for x, y in zip(v, w):
                dot, n, m = dot + x * y, n + x * x, m + y * y
            s = dot / math.sqrt(n * m) if n * m else math.nan
            s = math.inf if math.isnan(s) else max(-1.0, min(s, 1.0))
            if s > floor:
                s = s if s == math.inf else math.floor((s + nudge) * 10.0**digits + 0.5) / 10.0**digits
                found.append((-s, min(a, b), max(a, b)))
    return [(a, b, -s) for s, a, b in sorted(found)[:k]]


def _vectors_with_ties(odd):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 4)).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 7] * f).tolist(), i % 2) for i, f in enumerate([1.0] * 21 + [0.5, 2.0, 4.0] * 5)]  # copies and multiples: ties at 1.0
    rows += [(150 + i, (base[i % 3] + rng.normal(size=4) * 2e-3).astype(np.float32).tolist(), i % 2) for i in range(40)]  # ties of rounded cosines
    if odd:
        rows += [(200, [0.0] * 4, 0), (201, [1.0, float("nan"), 0.0, 0.0], 1), (202, [1.0, None, 0.0, 0.0], 1), (203, [1.0, 2.0], 1), (204, [2.0, 1.0], 1), (205, [], 0), (206, [1.0] * 4, None), (3, base[4].tolist(), 1), (3, base[3].tolist(), 1)]
    return [rows[i] for i in rng.permutation(len(rows))]


def test_top_pairs_equal_brute_force_in_tiles(monkeypatch):
    for odd in (False, True):
        rows = [r for r in _vectors_with_ties(odd) if r[2] is not None and len(r[1]) == 4 and None not in r[1]]
        for label in (0, 1):
            own = [r for r in rows if r[2] == label]
            ids, v = np.array([r[0] for r in own]), np.array([r[1] for r in own])
            for tile in ((2, 3), (3, 7), (1024, 4096)):
                for name, x in zip(("TILE_ROWS", "TILE_COLUMNS", "SCORED"), (*tile, 4 if tile[0] < 9 else 8192)):
                    monkeypatch.setattr(vectors, name, x)
                for k, digits, nudge in ((1, 5, 3e-7), (5, 2, 0.0), (30, 5, 3e-7), (5000, 3, 3e-7)):
                    got = vectors._best_pairs(one := vectors._Vectors(ids, v), one, k, 0.2, digits, nudge)
                    assert [(a, b, math.inf if math.isnan(s) else s) for a, b, s in got] == _all_pairs(own, k, 0.2, digits, nudge)


def test_top_pairs_equal_brute_force_in_blocks(spark):
    rows = _vectors_with_ties(True)
    df = spark.createDataFrame(rows, "id bigint, v array<float>, label int").repartition(3)
    for k, values in ((7, 40), (300, 40), (30, 1 << 21)):
        got = [(r.a, r.b, math.inf if math.isnan(r.s) else r.s) for r in vectors.top_pairs(df, k, 0.2, 5, 3e-7, values).collect()]
        assert got == _all_pairs(rows, k, 0.2, 5, 3e-7)


@pytest.mark.parametrize("odd", [False, True])
def test_equiv_pairs_take_ties_as_duckdb_does(spark, tmp_path, odd):
    import duckdb

    from stallwright.plans import all_queries

    rows = [(i, v, label) for i, v, label in _vectors_with_ties(False)] + [(200, [0.0] * 4, 0)] * odd
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = all_queries()[0]["scr_equiv_pairs"](spark, str(tmp_path))
    assert "Join Inner" not in df._jdf.queryExecution().optimizedPlan().toString()  # no pair of rows is a row
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert [tuple(map(str, r)) for r in df.collect()] == [tuple(map(str, r)) for r in c.execute(all_queries()[1]["scr_equiv_pairs"]).fetchall()]


def test_market(spark):
    rows = [("Active",), ("Active",), ("Sold",), ("Ended",), ("OutOfStock",)]
    df = spark.createDataFrame(rows, "status string")
    assert df.agg(market.batch_status(F.col("status")).alias("s")).first().s == "PartialFailure"
    assert df.limit(0).agg(market.batch_status(F.col("status")).alias("s")).first().s == "Queued"
    r = spark.range(1).select(market.sell_through(F.lit(3), F.lit(1)).alias("a"), market.sell_through(F.lit(0), F.lit(0)).alias("b"), market.can_update(F.lit("Sold"), F.lit("Active")).alias("c"), market.can_update(F.lit(None).cast("string"), F.lit("Active")).alias("d")).first()
    assert tuple(r) == (25, 0, False, True)


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.pattern_matches(F.lit("pro"), F.lit("PS5 Pro Console"))) and not one(X.pattern_matches(F.lit("pro"), F.lit("PS5 Professional Grade")))
    assert one(X.tokens(F.lit("Café PS5 a PS5"))) == ["café", "ps5"]
    assert one(X.stem_variants(F.lit("disk"), F.lit("disc"))) and not one(X.stem_variants(F.lit("ab"), F.lit("abs")))
    assert one(X.llm_json(F.lit('```json\n{"a": "b", "c": null}\n```'))) == {"a": "b"}
    assert one(L.condition_tier(F.lit("Phone for parts"), F.lit(""))) == 4
    assert one(L.quantity_mismatch(F.lit("Lot of 5 pads"), F.lit("pad")))
    assert one(L.storage_mismatch(F.lit("512GB"), F.lit("1TB"))) and not one(L.storage_mismatch(F.lit("128/256GB"), F.lit("1TB")))
    assert one(L.fingerprint_diff(L.fingerprint(F.lit("DeWalt 18V")), L.fingerprint(F.lit("DeWalt 20V")))) == []


def test_ngrams_of_repeated_line_items_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from stallwright.plans import all_queries

    spark.createDataFrame([(1, "red ring widget large", "Brand#7", "PROMO", 5), (2, "", "", "the", None)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(10, "1-URGENT", "2000-01-01"), (20, "2-HIGH", "2000-01-02")], "o_orderkey bigint, o_orderpriority string, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    line = (10, 1, 5, 1, 2.0, 10.0, 0.1, "A", "F", "2000-01-03")
    rows = [line, line, (20, 1, 5, 1, 2.0, 10.0, 0.1, "A", "F", "2000-01-03"), (20, 2, 5, 2, 2.0, 10.0, 0.1, "A", "F", "2000-01-03")]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    queries, oracle = all_queries()
    found = queries["str_ngrams"](spark, str(tmp_path))
    sql = sorted(c.execute(f"SELECT listing_id, n, kinds FROM ({oracle['str_ngrams']})").fetchall())
    assert sorted(tuple(r) for r in found.select("listing_id", "n", "kinds").collect()) == sql and len(sql) == 2
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_pages(spark):
    card = '<li class="s-card" data-viewport="1"><a class="s-card__link" href="https://x/itm/{id}?a"><div class="s-card__title">New listing{t}</div></a><span class="s-card__price">{p}</span><span>+ £3.50 delivery</span><p>Sold  25 Nov 2025</p></li>'
    page = "<ul>" + card.format(id="1234567890", t="Pad", p="£12.50") + card.format(id="1234567891", t="Many", p="£1 to £2") + card.format(id="12", t="No id", p="£1") + "</ul>"
    r = html.search_listings(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id bigint, html string")).collect()
    assert [(x.listing_id, x.title, x.price, x.currency, x.shipping, str(x.sold_date)) for x in r] == [("1234567890", "Pad", 12.5, "GBP", 3.5, "2025-11-25")]
    item = '<h1 class="x-item-title__mainTitle">Pad</h1><div class="x-price-primary"><span class="ux-textspans">US $1,299.00</span></div><div class="d-statusmessage">Item sold on Sun</div><div class="x-buybox-cta">Buy it now</div>'
    r = html.item_listings(spark.createDataFrame([(1, item), (2, None)], "page_id bigint, html string")).orderBy("page_id").collect()
    assert (r[0].price, r[0].currency, r[0].status, r[0].purchase_format, r[1].status) == (1299.0, "USD", "Sold", "BuyItNow", "Unknown")
    assert html.cleaned_text("<nav>x</nav><p>a&nbsp;b</p><div class='side-menu'>y</div><script>z</script>") == "a b"
    assert html.cleaned_text(None) is None


def test_search_pages_are_bounded_and_keep_every_card(spark, monkeypatch):
    from stallwright.plans import ingest_queries

    seen = []
    search = html.search_listings
    monkeypatch.setattr(html, "search_listings", lambda pages: seen.append(pages) or search(pages))
    monkeypatch.setattr(ingest_queries, "CARDS", 2)
    rows = ingest_queries.src_html_search(spark, "/root/testdata/sf0.001").select("page_id", "listing_id", "title", "price").collect()
    cards, most = seen[0].select(F.regexp_count("html", F.lit('<li class="s-card"')).alias("n")).agg(F.sum("n"), F.max("n")).first()
    monkeypatch.setattr(ingest_queries, "CARDS", 1_000_000)
    assert len(rows) == cards and sorted(rows) == sorted(ingest_queries.src_html_search(spark, "/root/testdata/sf0.001").select("page_id", "listing_id", "title", "price").collect())
    assert most < seen[1].select(F.max(F.regexp_count("html", F.lit('<li class="s-card"')))).first()[0]


def test_ingest(spark):
    old = spark.createDataFrame([("a", 1, "Sold", 1.0), ("b", 1, "Active", 2.0)], "listing_id string, job_id bigint, status string, price double")
    new = spark.createDataFrame([("a", 1, "Active", 9.0), ("b", 1, "Sold", 3.0), ("c", 2, "Active", 4.0)], old.schema)
    assert sorted(map(tuple, ingest.upsert(old, new).collect())) == [("a", 1, "Sold", 1.0), ("b", 1, "Sold", 3.0), ("c", 2, "Active", 4.0)]
    assert {r.listing_id: r.kind for r in ingest.classified(new, old).collect()} == {"a": "terminal", "b": "sold", "c": "new"}


def test_split_is_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 4).alias("g"), (F.col("id") % 2 == 0).alias("y"))
    n = {(r.g, r.part): r["count"] for r in sampling.split(df, ["g", "y"], "k", {"train": 0.8, "dev": 0.1, "test": 0.1}).groupBy("g", "part").count().collect()}
    assert all(n[g, "train"] == 200 and n[g, "dev"] == n[g, "test"] == 25 for g in range(4))


def test_ward_and_farthest_take_every_vector_of_a_label(spark, tmp_path, monkeypatch):
    from stallwright.operators import clustering
    from stallwright.plans import taxonomy_queries as Q

    monkeypatch.setattr(clustering, "MOST", 4)
    rows = [(k, 1, [float(k * k), 1.0]) for k in range(12)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r.vec_id for r in Q.ward_cut(spark, str(tmp_path)).collect()) == list(range(12))
    assert Q.ward_linkage(spark, str(tmp_path)).count() == 11
    assert {0, 11} <= {r.vec_id for r in Q.smp_farthest(spark, str(tmp_path)).collect()} and Q.smp_farthest(spark, str(tmp_path)).count() == 10
