import random
import zlib

import numpy as np
from helpers import docs, prose

from stallwright.llm import quality_mil as Q
from stallwright.llm import toxicity as T
from stallwright.llm.common import tidy


def test_a_worker_gives_back_what_a_task_has_freed():
    """Arrays of 8 KB, as a fit's, come from the heap; with a block left above them it keeps all of them."""
    kept = []

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(batches):
        small = [np.ones(1000) for _ in range(20_000)]
        kept.append(np.ones(1000))
        yield len(small)

    start = resident()
    assert list(run(())) == [20_000]
    untidy = resident() - start
    assert list(tidy(run)(())) == [20_000]
    assert resident() - start < 60e6 < untidy


def fitted(texts, y, **options):
    return T.fit([T.terms(t) for t in texts], [T.word_ids(t) for t in texts], np.array(y), **options)


def test_machine_learns_what_only_pairs_show():
    """Exactly one of two words is toxic: neither word alone says anything, and no linear weights fit."""
    r, texts, y = random.Random(5), [], []
    for k in range(1600):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(prose(k, 12) + " insult" * a + " group" * b)
        y.append(float(a != b))
    right = {}
    for factors in (T.FACTORS, 0):
        m = fitted(texts[:1200], y[:1200], factors=factors, epochs=40)
        right[factors] = np.mean([(m.score(T.terms(t)) >= 0.5) == bool(label) for t, label in zip(texts[1200:], y[1200:])])
        if factors:
            scores = [m.score(T.terms(f"w1 w2 {x}")) for x in ("insult group", "insult", "group", "none")]
            assert max(scores[0], scores[3]) < 0.3 and min(scores[1:3]) > 0.7
    assert right[T.FACTORS] > 0.98 and right[0] < 0.65


def test_machine_learns_a_conjunction():
    r, texts, y = random.Random(6), [], []
    for k in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(prose(k, 12) + " insult" * a + " group" * b)
        y.append(float(a and b))
    m = fitted(texts, y, epochs=30)
    both, one, other = (m.score(T.terms(f"w1 w2 {x}")) for x in ("insult group", "insult", "group"))
    assert both > 0.7 > 0.4 > max(one, other)


def test_score_equals_the_sum_over_all_pairs():
    m = fitted([prose(k, 30) + " vile" * (k % 2) for k in range(200)], [float(k % 2) for k in range(200)])
    ids = T.terms("vile w1 w2 vilest")
    rows = m.slot[ids]
    z = m.bias + sum(m.w[i] for i in rows) + sum(m.v[i] @ m.v[j] for k, i in enumerate(rows) for j in rows[k + 1 :])
    assert abs(m.score(ids) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    texts = {k: prose(k, 60) + (" vilestem" + "abcde"[k % 5] if k % 4 == 0 else "") for k in range(600)} | {900: None, 901: ""}
    df = docs(spark, texts, {"score": 3, "y": 1})
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)] + [(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    m = T.train(df, labels)
    got = {r.doc_id: r.score for r in T.scored(df, m).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.7) == (k % 4 == 0) for k in held]) > 0.97
    assert got[900] == got[901] < 0.7
    kept = T.clean(df, m)
    assert kept.columns == df.columns and {900, 901} <= {r.doc_id for r in kept.collect()}
    assert T.scored(df.limit(0), m).count() == 0
    long = docs(spark, {1: texts[4] + " x" * 300_000, 2: texts[4] + " x", 3: texts[4] + " x"})
    assert len({r.score for r in T.scored(long.unionByName(long), m).collect()}) == 1
    assert {r.score for r in T.scored(df, T.train(df, labels.limit(0))).collect()} == {0.5}
    assert max(r.score for r in T.scored(df, T.train(df, labels.where("toxic = 0"))).collect()) < 0.05


def test_quality_attends_to_the_bad_passage(spark):
    bad = " ".join(f"{w}***" for w in prose(1, 60).split())
    texts = {k: prose(k, 200) + " " + (bad if k % 5 == 1 else prose(k + 9000, 60)) + " " + prose(k + 5000, 100) for k in range(500)} | {900: None, 901: "", 902: prose(3, 30_000)}
    df = docs(spark, texts, {"bag": 1})
    labels = spark.createDataFrame([(k, int(k % 5 != 1), 0) for k in range(500)], "doc_id bigint, quality int, toxic int")
    net = Q.train(df, labels)
    got = {r.doc_id: r.score for r in Q.scored(df, net).collect()}
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.3) == (k % 5 != 1) for k in held]) > 0.97
    assert net.attention(texts[1]).argmax() in (4, 5)
    again = Q.scored(df.unionByName(df), net).groupBy("doc_id").agg({"score": "min", "*": "count"}).collect()
    assert all(r["min(score)"] == got[r.doc_id] and r["count(1)"] == 2 for r in again)
    assert Q.scored(df.limit(0), net).count() == 0
    assert got[900] == got[901] and 0 <= got[902] <= 1
    assert {r.score for r in Q.scored(df, Q.train(df, labels.limit(0))).collect()} == {0.5}


def test_quality_learns_words():
    """Good and bad texts look alike, they differ in the words of one passage only."""
    r = random.Random(8)
    texts, y = [], []
    for k in range(400):
        good = k % 2
        mid = " ".join(r.choice(["oak", "elm", "ash"] if good else ["tin", "mud", "rag"]) for _ in range(30))
        texts.append(prose(k, 96) + " " + mid + " " + prose(k + 7000, 66))
        y.append(float(good))
    bags, words = [Q.passages(t) for t in texts], [Q.word_ids(t) for t in texts]
    net = Q.fit(bags[:300], words[:300], np.array(y[:300]), epochs=25)
    right = np.mean([(net.score(t) >= 0.5) == bool(label) for t, label in zip(texts[300:], y[300:])])
    assert right > 0.95 and net.attention(texts[0]).argmax() == 2


def test_quality_gradients_equal_differences():
    texts, y = [prose(k, 20 + 60 * k) for k in range(4)], np.array([1.0, 0, 1, 0])
    bags, words = [Q.passages(t) for t in texts], [Q.word_ids(t) for t in texts]
    net = Q.fit(bags, words, y, epochs=1)
    net.p = {k: a.astype(float) for k, a in net.p.items()}
    sizes = np.array([len(b) for b in bags])
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(4), sizes)
    place = np.concatenate([np.arange(len(w)) // Q.PASSAGE + s for w, s in zip(words, starts)])
    ids, x = np.concatenate(words), np.clip((np.concatenate(bags) - net.mean) / net.std, -8, 8)
    rest = (x, starts, of, ids, place, np.maximum(1, np.bincount(place, minlength=len(of))))
    loss = lambda: -np.mean(np.log(np.where(y == 1, out := net.forward(*rest)["y"], 1 - out)))
    for name, g in Q.gradients(net, y, *rest).items():
        at = (ids[0], 3) if name == "E" else tuple(0 for _ in np.shape(g))
        kept = np.array(net.p[name])
        up, down = kept.copy(), kept.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        net.p[name] = up
        high = loss()
        net.p[name] = down
        low = loss()
        net.p[name] = kept
        assert abs((high - low) / 2e-5 - g[at]) < 1e-6, name


def test_queries(spark, tmp_path):
    texts = {k: prose(k, 60) + (" vilestem" if k % 4 == 0 else "") + (" ***" * 20 if k % 5 == 1 else "") for k in range(400)} | {900: None, 901: ""}
    docs(spark, texts, {"y": 1}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 5 != 1), int(k % 4 == 0)) for k in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    from stallwright.llm.queries import QUERIES

    for name, folds, out, cut, want in (("op4_toxicity", 3, 1, 0.7, lambda k: k % 4 == 0), ("op8_quality", 5, 0, 0.3, lambda k: k % 5 != 1)):
        df = QUERIES[name](spark, str(tmp_path))
        assert df.columns == ["doc_id", "held_out", "score", "predicted"]
        rows = {r.doc_id: r for r in df.collect()}
        assert rows.keys() == texts.keys()
        for k, r in rows.items():
            assert r.held_out == (zlib.crc32(str(k).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        held = [k for k in range(400) if rows[k].held_out]
        assert np.mean([rows[k].predicted == want(k) for k in held]) > 0.95
