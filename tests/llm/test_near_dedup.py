import numpy as np
import pytest
from helpers import docs, prose

from stallwright.llm import near_dedup as N


def edited(text, k, seed):
    w = text.split()
    step = len(w) // k
    for i in range(k):
        w[(i * step + seed) % len(w)] = f"x{seed}x{i}"
    return " ".join(w)


def test_registers_estimate_probability_jaccard():
    a, b = N.shingles(prose(1, 300)), N.shingles(edited(prose(1, 300), 6, 3))
    sa, sb = (a[0], N.weights(a[1])), (b[0], N.weights(b[1]))
    sig = N.registers([sa, sb], 4096)
    assert abs((sig[0] == sig[1]).mean() - N.probability_jaccard(sa, sb)) < 0.04
    assert (N.registers([sa], 64) == N.registers([sa], 64)).all()


def test_probability_jaccard_of_weights():
    h = np.arange(3, dtype=np.uint64)
    x, y = np.array([1.0, 2.0, 3.0]), np.array([2.0, 1.0, 3.0])
    want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(3)) for i in range(3))
    assert N.probability_jaccard((h, x), (h, y)) == pytest.approx(want)


def sample():
    base = {k: prose(k, 120) for k in range(6)}
    out = dict(base)
    out |= {100 + k: edited(base[0], 2, k) for k in range(30)}  # a group whose members are less alike than 0.8
    out |= {200 + k: base[1] for k in range(5)}
    out |= {300: None, 301: "", 302: "one two", 303: "one two", 304: "one", 305: prose(9, 30_000), 306: edited(prose(9, 30_000), 3, 1)}
    return out


def test_classes_equal_brute_force(spark):
    texts = sample()
    got = {r.doc_id: r.class_id for r in N.classes(docs(spark, texts, {"bands": 1, "digest": "x", "class_id": 7})).collect()}
    assert got == N.brute_force(texts)


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LARGE", 3)
    texts = sample()
    got = {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()}
    assert got == N.brute_force(texts)


def test_deduplicated_keeps_one_row_of_each_class(spark):
    texts = sample()
    df = docs(spark, texts, {"digest": "x", "_digest": 1, "_gone_id": 2, "_x0": 3})
    twice = df.unionByName(df)  # repeated rows
    kept = N.deduplicated(twice)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(N.brute_force(texts).values()))


def test_null_ids_and_empty_table(spark):
    t = prose(3, 50)
    rows = [(None, t, "en", "s", 1), (5, t, "en", "s", 1), (None, "alone here", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in N.classes(df).collect()) == [(0, 0, True), (0, 5, False), (5, 5, True)]
    assert N.classes(df.limit(0)).count() == 0 and N.deduplicated(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("900", "901")], "a string, b string")
    got = {r.node: r.root for r in N.components(links).collect()}
    assert set(got.values()) == {"000", "900"} and len(got) == 43


def uneven(seed, times):
    """20 of 100 shingles `times` times, 80 once; the set of shingles is the same for any `times`."""
    w = [f"s{seed}w{k}" for k in range(100)]
    return " ".join(w[:20] * times + w)


def test_pairs_with_unequal_counts_are_linked(spark):
    texts = {2 * seed + k: uneven(seed, times) for seed in range(12) for k, times in enumerate((1, 1000))}
    assert all(N.similarity(N.shingles(texts[2 * s]), N.shingles(texts[2 * s + 1])) == 1 for s in range(12))
    got = {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()}
    assert got == {d: d - d % 2 for d in texts}


def weighted_pair(seed, k):
    """Texts of 94 shingles, of which 74 are common; 30 of these have 54 or 55 occurrences in both."""
    w = [f"s{seed}w{i}" for i in range(74)]
    return " ".join(w[:30] * 54 + w + [f"s{seed}x{k}y{i}" for i in range(20)])


@pytest.mark.parametrize("large", [16, 1])
def test_probability_jaccard_links(spark, monkeypatch, large):
    monkeypatch.setattr(N, "LARGE", large)
    texts = {10 * seed + k: weighted_pair(seed, k) for seed in range(3) for k in range(3)}
    (ha, ca), (hb, cb) = N.shingles(texts[0]), N.shingles(texts[1])
    assert len(np.intersect1d(ha, hb)) / len(np.union1d(ha, hb)) < 0.7 < 0.8 <= N.probability_jaccard((ha, N.weights(ca)), (hb, N.weights(cb)))
    got = {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()}
    assert got == {d: d - d % 10 for d in texts}


def test_large_bucket_condition_equals_similarity(spark):
    from pyspark.sql import functions as F

    parts = [uneven(0, 1), uneven(0, 1000), weighted_pair(1, 0), weighted_pair(1, 1), prose(1, 300), edited(prose(1, 300), 6, 3), edited(prose(1, 300), 20, 3), "one"]
    texts = spark.createDataFrame([(bytes([k]), t) for k, t in enumerate(parts)], "digest binary, _text string")
    sets = N.shingle_sets(texts).withColumn("s", F.array(*[F.lit(0).cast("bigint")] * 8))
    a, b = (sets.select(F.col("digest").alias(x), F.col("levels").alias(f"l{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    got = {(r.a[0], r.b[0]) for r in a.join(b, F.col("a") < F.col("b")).where(N._alike(0.8)).collect()}
    s = [N.shingles(t) for t in parts]
    assert got == {(i, j) for i in range(8) for j in range(i + 1, 8) if N.similarity(s[i], s[j]) >= 0.8} and {(0, 1), (2, 3), (4, 5)} <= got


def repeated_lines(seed, words):
    """A text whose first ten words come 80 times before it."""
    w = [f"s{seed}w{k}" for k in range(words)]
    return " ".join(w[:10] * 80 + w)


def test_recall_of_pairs_on_repeated_lines(spark):
    """60 words against the same with 80 repeats of ten before them and one word more: plain Jaccard 0.9, weighted far less."""
    n = 150
    texts = {2 * s: " ".join(f"s{s}w{k}" for k in range(60)) for s in range(n)} | {2 * s + 1: repeated_lines(s, 61) for s in range(n)}
    s = N.similarity(N.shingles(texts[0]), N.shingles(texts[1]))
    (ha, ca), (hb, cb) = N.shingles(texts[0]), N.shingles(texts[1])
    assert s > 0.8 > N.probability_jaccard((ha, N.weights(ca)), (hb, N.weights(cb)))
    got = {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(n)) >= 0.99 * n


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.83, each with a partner of its own."""
    n, texts = 200, {}
    for k in range(n):
        base = [f"p{k}w{i}" for i in range(300)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(base[: 268 + k % 5] + [f"q{k}x{i}" for i in range(28)])
    assert all(0.8 <= N.similarity(N.shingles(texts[2 * k]), N.shingles(texts[2 * k + 1])) < 0.85 for k in range(n))
    got = {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(n)) >= 0.99 * n and len(set(got.values())) <= n + 2


def test_hot_leader_is_split(spark, monkeypatch):
    from stallwright.llm import common

    monkeypatch.setattr(common, "TOGETHER", 5)
    texts = sample() | {1000 + k: prose(4, 120) + f" end{k}" for k in range(60)}
    got = {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()}
    assert got == N.brute_force(texts)
