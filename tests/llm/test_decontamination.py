from helpers import docs, prose

from stallwright.llm import decontamination as D

ITEMS = [(1, prose(1, 30)), (2, "Short question, why?"), (3, None), (4, "..."), (5, prose(1, 30)), (None, prose(7, 12))]


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


TEXTS = {
    1: prose(50, 40) + " " + " ".join(prose(1, 30).upper().split()[4:19]) + " " + prose(51, 30),
    2: "I ask: SHORT -- question... why? again",
    3: None,
    4: "",
    5: prose(60, 20_000),
    6: "été " + prose(7, 12).replace(" ", ", ") + " ça",
}


def test_equals_brute_force(spark):
    items = [("null" if k is None else str(k), t) for k, t in ITEMS]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in D.digest(D.contamination(docs(spark, TEXTS, {"n_hit": 3, "spans": "x"}), bench(spark))).collect()}
    assert got == {k: D.brute_force(t, items) for k, t in TEXTS.items()}
    assert got[1][1] == 15 and got[2][2] == 1


def test_spans_point_into_the_original(spark):
    rows = {r.doc_id: r for r in D.contamination(docs(spark, TEXTS), bench(spark), keep=("doc_id", "text")).collect()}
    s = rows[6].spans[0]
    assert rows[6].text[s.start : s.end] == prose(7, 12).replace(" ", ", ")


def test_chunks_of_a_large_benchmark_give_the_same(spark):
    one = D.digest(D.contamination(docs(spark, TEXTS), bench(spark))).collect()
    many = D.digest(D.contamination(docs(spark, TEXTS), bench(spark), max_chars=100)).collect()
    assert sorted(one) == sorted(many)


def test_clean_and_empty(spark):
    df = docs(spark, TEXTS, {"items": "x"})
    assert sorted(r.doc_id for r in D.clean(df, bench(spark)).collect()) == [3, 4, 5]
    assert sorted(r.doc_id for r in D.clean(df, bench(spark), max_chars=100).collect()) == [3, 4, 5]
    assert D.clean(df, bench(spark).limit(0)).count() == 6
    assert D.contamination(df.limit(0), bench(spark)).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from stallwright.llm.queries import ORACLE_SQL, QUERIES

    docs(spark, TEXTS | {9: "SHORT question, why"}, {"item": 1}).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).where("item_id IS NOT NULL").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = QUERIES["op9_decontamination"](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL["op9_decontamination"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 7


def test_kept_columns_that_clash(spark):
    df = docs(spark, TEXTS, {"_r": 1, "n_hit": 9, "digest": 2, "_x0": 3})
    for most in (D.MAX_CHARS, 300):
        rows = D.contamination(df, bench(spark), keep=("doc_id", "_r", "n_hit", "text", "digest"), max_chars=most)
        assert rows.columns == ["doc_id", "_r", "text", "digest", "n_words", "n_hit", "items", "spans"]
        assert {(r.doc_id, r.text) for r in rows.collect()} == set(TEXTS.items())
        assert D.clean(df, bench(spark), max_chars=most).columns == df.columns
    twice = df.unionByName(df)
    assert D.clean(twice, bench(spark), max_chars=300).count() == 6 and D.contamination(twice, bench(spark), max_chars=300).count() == 12
