"""Near-duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

Elements are shingles of five words, weighted 1 + ln(count). Every element is a Poisson process whose rate is its
weight; each arrival falls on one of the registers, and a register keeps the element of its first arrival. Arrivals
are generated only up to a time by which all registers of the document are expected to be filled (early
termination); documents with an empty register go on to twice that time. Two documents agree in a register with
their probability Jaccard similarity. Registers form bands of `ROWS`; documents that share a band are candidates.
Texts whose shingle counts differ among each other get a second set of registers over unit weights, which agree with
the plain Jaccard similarity; elsewhere both are the same. Either set's bands and sketch make a pair a candidate.

Texts that are equal become one node first. In each bucket every node is compared with the bucket's smallest one
only; links that pass give components. Where a bucket still holds several components, nodes of different ones are
joined under a condition on 1-bit sketches inside the join, so only pairs that are close already are emitted; in
buckets with more than `LARGE` open nodes the condition is the similarity itself, on the shingle hashes that
verification uses too, after `ROUNDS` more round against one leader each, so that a large group of half-similar texts
emits little but the links that join its components. As the condition is the same, one pair stands for all that link
the same components. All candidates are verified exactly on the texts: a link has a plain or a probability Jaccard
similarity of at least `THRESHOLD`. A node that very many others are compared with is repeated, and these dealt over
tasks. Classes are the connected components, by alternating large-star and small-star steps (rows of 32 bytes, whose
hubs adaptive execution splits); nothing but counters reaches the driver. A pair of similarity 0.8 is missed with
probability 2.7e-5 (1.8e-5 share no band, 1.0e-5 differ in more than `MOST_BITS` sketch bits), whatever its counts.

Cases: null is the empty text; texts of one to four words are one shingle; texts without words have equal texts as
their only partners; very long texts are read whole; repeated rows and ties fall into one class; rows with a null
doc_id belong to their text's class, whose id is the smallest doc_id in it, null if it has none; an empty table gives
an empty result; extra columns are ignored (`deduplicated` keeps them, whatever their names).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_names, joined, release, table, text_digest, tidy, utf8, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
#: Most differing sketch bits of candidates: 21.6 are expected at similarity 0.8, with a deviation of 4.4.
MOST_BITS = 42
#: Ids up to this many are broadcast (16 bytes each); above, Spark joins by shuffling.
FEW = 500_000
LARGE, ROUNDS = 16, 1
BATCH_WORDS, CACHE = 60_000, 60_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
_FULL = (1 << 64) - 1


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_ids = WordIds()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    w = words(text)
    ids = np.fromiter(map(_ids.__getitem__, w), np.uint64, len(w))
    return np.unique(_grams(ids, n), return_counts=True)


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    if not len(ids):
        return ids
    size = min(n, len(ids))
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = (out + ids[k : len(ids) - size + 1 + k]) * PRIME
    return mixed(out)


def registers(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """For each (hashes, weights) the element hash in each of m registers; rows of empty sets are 0."""
    out = np.zeros((len(sets), m), np.uint64)
    todo, reach = np.array([k for k, s in enumerate(sets) if len(s[0])], np.int64), np.log(m) + 3.0
    while len(todo):
        h = np.concatenate([sets[k][0] for k in todo])
        w = np.concatenate([sets[k][1] for k in todo])
        sizes = [len(sets[k][0]) for k in todo]
        doc = np.repeat(np.arange(len(todo)), sizes)
        until = (m * reach / np.bincount(doc, w))[doc]
        best, who = np.full(len(todo) * m, np.inf), np.zeros(len(todo) * m, np.uint64)
        time, step = np.zeros(len(h)), 0
        arrivals: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(h):
            step += 1
            r = mixed(h + np.uint64(step * int(PRIME) & _FULL))
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 1) / (1 << 53)) / w
            alive = time <= until
            h, w, doc, until, time, r = (x[alive] for x in (h, w, doc, until, time, r))
            at = doc * m + (mixed(r ^ PRIME) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, at, time)
            arrivals.append((at, time.copy(), h))
        for at, t, x in arrivals:
            first = best[at] == t
            who[at[first]] = x[first]
        full = np.isfinite(best).reshape(len(todo), m).all(1)
        out[todo[full]] = who.reshape(len(todo), m)[full]
        todo, reach = todo[~full], 2 * reach
    return out


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    only_a, only_b = a[1].sum() - a[1][i].sum(), b[1].sum() - b[1][j].sum()
    x, y = a[1][i], b[1][j]
    ratio, n = np.unique(x / y, return_inverse=True)
    total = np.array([np.maximum(x, q * y).sum() + only_a + q * only_b for q in ratio])
    return float((x / total[n]).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of plain and probability Jaccard similarity of two sets of (hashes, counts)."""
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    plain = common / max(1, len(a[0]) + len(b[0]) - common)
    return max(plain, probability_jaccard((a[0], weights(a[1])), (b[0], weights(b[1])))) if common else 0.0


def banded(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and four sketch words of each row of registers; bits of different registers are independent."""
    keys = np.zeros((len(sig), BANDS), np.uint64)
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for k in range(ROWS):
        keys = mixed((keys + parts[:, :, k]) * PRIME)
    keys = mixed(keys + np.arange(BANDS, dtype=np.uint64) * PRIME).astype(np.int64)
    bits = np.zeros((len(sig), 256), np.uint8)
    bits[:, :REGISTERS] = (mixed(sig + np.arange(REGISTERS, dtype=np.uint64) * PRIME) >> np.uint64(63)).astype(np.uint8)
    return keys, np.packbits(bits, axis=1).view(np.int64)


def signatures(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, digest of the text, band keys and sketch words: four of the weighted registers, four of the unit ones.

    Band keys are null where the same task has met the text before.
    """
    schema = "doc_id bigint, digest binary, bands array<bigint>, sketch array<bigint>"

    def flush(sets: list, rows: list) -> Iterator[pa.RecordBatch]:
        keys, sketch = banded(registers([(h, weights(c)) for h, c in sets]))
        bands, sketch = list(keys), np.concatenate([sketch, sketch], axis=1)
        uneven = [k for k, (_, c) in enumerate(sets) if len(c) and c.min() < c.max()]
        more, sketch[uneven, 4:] = banded(registers([(sets[k][0], np.ones(len(sets[k][0]))) for k in uneven]))
        for k, x in zip(uneven, more):
            bands[k] = np.union1d(bands[k], x)
        out = [(d, g, None if k is None else bands[k].tolist() if len(sets[k][0]) else [], None if k is None else sketch[k].tolist()) for d, g, k in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["doc_id", "digest", "bands", "sketch"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sets, rows, n = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                digest = hashlib.md5(utf8(t)).digest()
                if digest in seen:
                    rows.append((d, digest, None))
                else:
                    if len(seen) > CACHE:
                        seen.clear()
                    seen.add(digest)
                    rows.append((d, digest, len(sets)))
                    sets.append(shingles(t))
                    n += len(sets[-1][0])
                if n >= BATCH_WORDS or len(rows) >= 5_000 or len(sets) >= 100:
                    yield from flush(sets, rows)
                    sets, rows, n = [], [], 0
        if rows:
            yield from flush(sets, rows)

    return docs.select(F.col(f"`{id}`").cast("bigint"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)



def _close(a: str, b: str):
    """Whether the weighted or the unit sketches differ in few bits."""
    weighted, unit = (sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(at + 1, at + 4)), F.bit_count(F.col(a)[at].bitwiseXOR(F.col(b)[at]))) for at in (0, 4))
    return (weighted <= MOST_BITS) | (unit <= MOST_BITS)


def texts_of(ids: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """digest and _text, once for each of the digests."""
    few = ids.count() <= FEW
    texts = docs.select(text_digest(text).alias("digest"), F.col(f"`{text}`").cast("string").alias("_text"))
    return texts.join(F.broadcast(ids) if few else ids, "digest", "left_semi").dropDuplicates(["digest"])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """digest and its distinct shingle hashes, by levels of equal weight; one level has weight 1."""

    def levels(t: str | None) -> list[dict]:
        h, c = shingles(t)
        each = np.unique(c)
        return [{"w": float(weights(n)) if len(each) > 1 else 1.0, "h": h[c == n].view(np.int64).tolist()} for n in each]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [levels(t.as_py()) for t in b.column(1)]
            kind = pa.list_(pa.struct([("w", pa.float64()), ("h", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, kind)], names=["digest", "levels"])

    return texts.select("digest", "_text").mapInArrow(run, "digest binary, levels array<struct<w: double, h: array<bigint>>>")


def verified(pairs: DataFrame, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar enough, with the similarity."""
    pairs = cut(pairs)
    release(docs.sparkSession)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), docs, text)
    ta, tb = (texts.select(F.col("digest").alias(f"_{x}"), F.col("_text").alias(f"_t{x}")) for x in "ab")
    both = joined(pairs, "a", "b", ta, "_a", first=lambda rows: rows.join(tb, F.col("b") == F.col("_b"))).select("a", "b", "_ta", "_tb")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(64)(shingles)
        for batch in batches:
            s = [similarity(known(x.as_py()), shingles(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([x >= threshold for x in s], pa.bool_()))

    out = cut(both.mapInArrow(run, "a binary, b binary, similarity double"))
    release(docs.sparkSession)
    return out


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node on a link (a, b)."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError("components did not settle")


def _pairs(links: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, (x.select("a", "b") for x in links))


def _sum(x, f):
    return F.aggregate(x, F.lit(0.0), lambda total, y: total + f(y))


def _alike(threshold: float):
    """Whether the levels la and lb of shingle hashes have the similarity, plain or probability Jaccard.

    Sketches are compared first. Sums may differ in their last bits from those of `similarity`, so a little less than
    the threshold passes.
    """
    least = threshold - 1e-9
    na, nb = (_sum(x, lambda y: F.size(y["h"]).cast("double")) for x in ("la", "lb"))
    wa, wb = (_sum(x, lambda y: y["w"] * F.size(y["h"])) for x in ("la", "lb"))
    met = F.flatten(F.transform("la", lambda x: F.transform("lb", lambda y: F.struct(x["w"].alias("x"), y["w"].alias("y"), F.size(F.array_intersect(x["h"], y["h"])).cast("double").alias("n")))))

    def weighted(p, wa, wb):
        only_a, only_b = wa - _sum(p, lambda z: z["n"] * z["x"]), wb - _sum(p, lambda z: z["n"] * z["y"])

        def share(z, rest):
            q = z["x"] / z["y"]
            return z["n"] * z["x"] / (_sum(p, lambda o: o["n"] * F.greatest(o["x"], q * o["y"])) + rest["a"] + q * rest["b"])

        return F.transform(F.array(F.struct(only_a.alias("a"), only_b.alias("b"))), lambda rest: _sum(F.filter(p, lambda z: z["n"] > 0), lambda z: share(z, rest)))[0]

    def enough(p):
        common = _sum(p, lambda z: z["n"])
        return ((1 + least) * common >= least * (na + nb)) | ((F.size(p) > 1) & (weighted(p, wa, wb) >= least))

    one = (F.size("la") == 1) & (F.size("lb") == 1)
    return _close("sa", "sb") & (~one | (F.least(na, nb) >= least * F.greatest(na, nb))) & F.exists(F.array(met), enough)


def _met_again(rows: DataFrame, more: list[str], also) -> DataFrame:
    """Pairs (a, b) of nodes with different roots in a bucket, close in their sketches, that meet `also`."""
    names = {"digest": "", "root": "r", "sketch": "s"} | {c: c[0] for c in more}
    x, y = (rows.select("bucket", *(F.col(c).alias(n + side) for c, n in names.items())) for side in "ab")
    return x.join(y, (x["bucket"] == y["bucket"]) & (F.col("ra") < F.col("rb")) & _close("sa", "sb") & also).select("a", "b", "rb")


def _large_links(rows: DataFrame, sets: DataFrame, roots: DataFrame, links: list[DataFrame], docs: DataFrame, text: str, threshold: float) -> list[DataFrame]:
    """Links of the large buckets (bucket, digest); `sets` has the sketch and the levels of shingle hashes of their nodes.

    First against a leader that a hash picks, with work in proportion to the bucket; this joins the many members of
    a large class. What is left for the join of all that are still apart are nodes without a link to any leader.
    """
    a, b = ({c: f"{n}{side}" for c, n in (("digest", ""), ("sketch", "s"), ("levels", "l"))} for side in "ab")
    found: list[DataFrame] = []
    for k in range(ROUNDS + 1):
        now = rows.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        leader = F.min_by(F.struct(F.col("digest").alias("a"), F.col("root").alias("ra")), F.xxhash64("digest", F.lit(k)))
        still = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), leader.alias("l")).where("lo <> hi")
        if k < ROUNDS:
            met = now.select("bucket", F.col("digest").alias("b"), F.col("root").alias("rb")).join(still.select("bucket", "l.*"), "bucket").where("ra <> rb").select("a", "b", "ra").distinct()
            ours, theirs = sets.withColumnsRenamed(a | {"digest": "_a"}), sets.withColumnsRenamed(b | {"digest": "_b"})
            met = joined(cut(met), "a", "b", ours, "_a", also=_alike(threshold), first=lambda rows: rows.join(theirs, F.col("b") == F.col("_b")))
            pairs = met.groupBy("b", "ra").agg(F.min("a").alias("a"))
        else:
            pairs = _met_again(now.join(still.select("bucket"), "bucket", "left_semi").join(sets, "digest"), ["levels"], _alike(threshold)).groupBy("a", "rb").agg(F.min("b").alias("b"))
        found.append(verified(pairs.select("a", "b").distinct(), docs, text, threshold))
        if k < ROUNDS:
            roots = cut(components(_pairs(links + found)))
            release(docs.sparkSession)
    return found


def classes(docs: DataFrame, text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest, class_id (smallest doc_id of the class), class_size and kept (the one row that stays)."""
    sigs = cut(signatures(docs, text, id))
    members = sigs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    nodes = sigs.where("bands IS NOT NULL").select("digest", "bands", "sketch").dropDuplicates(["digest"])
    rows = nodes.select("digest", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("digest").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = cut(rows.join(shared, "bucket"))
    release(docs.sparkSession)
    sketches = nodes.select("digest", "sketch").join(met.select("digest").distinct(), "digest", "left_semi")
    sketches = cut(sketches)
    star = met.where("digest <> leader").select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct()
    star = cut(star)
    sa, sb = (sketches.select(F.col("digest").alias(f"_{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    close = joined(star, "a", "b", sa, "_a", also=_close("sa", "sb"), first=lambda rows: rows.join(sb, F.col("b") == F.col("_b")))
    links = verified(close.select("a", "b"), docs, text, threshold)
    roots = cut(components(links))
    release(docs.sparkSession)
    label = met.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("bucket", "digest", F.coalesce("root", "digest").alias("root"))
    open_buckets = label.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", (F.col("n") > LARGE).alias("large"))
    open_rows = cut(label.join(open_buckets, "bucket"))
    small = open_rows.where("NOT large").join(sketches, "digest")
    rest = _met_again(small, [], F.lit(True)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = [links, verified(rest.join(star, ["a", "b"], "left_anti"), docs, text, threshold)]
    large = open_rows.where("large").select("bucket", "digest")
    if large.limit(1).count():
        nodes_in = large.select("digest").distinct()
        sets = cut(shingle_sets(texts_of(nodes_in, docs, text)).join(sketches, "digest"))
        links += _large_links(large, sets, roots, links, docs, text, threshold)
    roots = components(_pairs(links))
    grouped = members.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    grouped = cut(grouped)
    release(docs.sparkSession)
    best = grouped.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.min_by("digest", F.struct(F.col("first").isNull(), "first", "digest")).alias("best"))
    found = grouped.join(best, "root").select("digest", "class_id", "class_size", "first", (F.col("digest") == F.col("best")).alias("_best"))
    out = sigs.select("doc_id", "digest").join(found, "digest")
    return out.select("doc_id", "digest", "class_id", "class_size", (F.col("_best") & F.col("doc_id").eqNullSafe(F.col("first"))).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one row of every class left: the one with the smallest doc_id."""
    found = cut(classes(docs, text, id, threshold))
    release(docs.sparkSession)
    gone_id, gone_digest, digest = fresh_names(docs, 3)
    named = lambda rows: rows.select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest))
    gone = named(found.where(~F.col("kept"))).distinct()
    again = named(found.where("kept").groupBy("doc_id", "digest").count().where("count > 1"))
    rows = docs.withColumn(digest, text_digest(text))
    same = F.col(digest).eqNullSafe(F.col(gone_digest)) & F.col(f"`{id}`").eqNullSafe(F.col(gone_id))

    def fit(d: DataFrame) -> DataFrame:
        return F.broadcast(d) if d.count() <= FEW else d

    gone, repeats = fit(cut(gone)), fit(cut(again))
    stay = rows.join(gone, same, "left_anti")
    once = stay.join(repeats, same, "left_anti")
    twice = stay.join(repeats, same, "left_semi").dropDuplicates([id, digest])
    return once.unionByName(twice).drop(digest)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def brute_force(texts: dict[int, str | None], threshold: float = THRESHOLD) -> dict[int, int]:
    """Class ids by comparing all pairs; for tests."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and ((texts[a] or "") == (texts[b] or "") or similarity(sets[a], sets[b]) >= threshold):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in texts}
