"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of the whole text and their prefixes of 4, 5 and 6 characters (inflected forms of a
stem then share weights), hashed to 2^20 ids. A linear weight and a factor vector go to the terms most associated with
the label on the training sample (chi-square), and to words that matter only together: pairs of words within `NEAR`
words of each other whose documents have another share of the label than those of either word alone. The score is the
logistic of ``b + sum w_i + 1/2 (|sum v_i|^2 - sum |v_i|^2)``, whose second part learns pairs of terms that are toxic
only together, or harmless only together. Trained by AdaGrad on a bounded sample (about `max_rows` rows and
`max_bytes` bytes of text outside the held-out fold); labels, lang, source and doc_id are never inputs.

Cases: null and empty texts have no terms and get the bias alone; without labelled rows every score is 0.5, with
labels of one class only the smoothed rate of that class; very long texts count each distinct term once, whatever
their length; repeated documents score alike; null ids count as not held out; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, release, table, tidy, words
from .learning import fold, training_sample

BITS, PREFIXES = 20, (4, 5, 6)
FOLDS, HELD_OUT, CUT = 3, 1, 0.7
MAX_ROWS, MAX_BYTES, TERMS, FACTORS, EPOCHS, SEED = 12_000, 36 << 20, 4096, 4, 20, 7
#: Pairs of words at most this far apart are looked at; those that stand out by `STANDS_OUT` deviations are taken, `PAIRS` at most.
NEAR, STANDS_OUT, PAIRS, LEAST = 5, 4.5, 512, 5
BUCKETS = 24
CACHE = 80_000


class TermIds(dict):
    """Hashed ids of a word, first, and of its prefixes; starts anew when it holds many words."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        text = word.decode()
        forms = [b"w" + word, *(b"p" + text[:n].encode() for n in PREFIXES if len(text) >= n)]
        self[word] = found = tuple(zlib.crc32(f) >> (32 - BITS) for f in forms)
        return found


_ids = TermIds()


def terms(text: str | None) -> np.ndarray:
    """Distinct term ids of a text, ascending."""
    found = set(itertools.chain.from_iterable(map(_ids.__getitem__, set(words(text)))))
    return np.sort(np.fromiter(found, np.int32, len(found)))


def word_ids(text: str | None) -> np.ndarray:
    """Ids of the words of a text, in their order."""
    w = words(text)
    return np.fromiter((_ids[x][0] for x in w), np.int32, len(w))


def near_pairs(ids: np.ndarray) -> np.ndarray:
    """Pairs of different words at most `NEAR` apart, as one number each; a pair comes as often as it occurs."""
    ids = ids.astype(np.int64)
    both = [(ids[:-k], ids[k:]) for k in range(1, min(NEAR, len(ids) - 1) + 1)]
    if not both:
        return np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*both))
    return (np.minimum(a, b) << BITS | np.maximum(a, b))[a != b]


def paired_terms(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Word ids of the pairs whose documents have another share of the label than those of either word alone.

    Pairs are first counted in hashed buckets; those of buckets that stand out at all are then counted each.
    """
    n, size, base = len(y), 1 << BITS, float(np.mean(y))
    kinds = [np.unique(t) for t in texts]
    df = np.bincount(np.concatenate(kinds), minlength=size)
    with_pos = np.bincount(np.concatenate([k for k, t in zip(kinds, y) if t]), minlength=size)
    rate = np.clip(with_pos / np.maximum(df, 1), 0.5 / n, 1 - 0.5 / n)
    texts = [t[df[t] >= LEAST] for t in texts]
    bucket = lambda pairs: (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS)).astype(np.int64)
    seen, pos = np.zeros(1 << BUCKETS, np.uint16), np.zeros(1 << BUCKETS, np.uint16)
    for t, label in zip(texts, y):
        at = np.unique(bucket(near_pairs(t)))
        seen[at] += 1
        if label:
            pos[at] += 1
    off = np.zeros(1 << BUCKETS, bool)
    for k in range(0, 1 << BUCKETS, 1 << 20):  # in slices, for the memory of what is computed on the way
        n_k, pos_k = seen[k : k + (1 << 20)].astype(np.float32), pos[k : k + (1 << 20)]
        off[k : k + (1 << 20)] = (n_k >= LEAST) & (np.abs(pos_k - n_k * base) >= 2.5 * np.sqrt(n_k * (base * (1 - base))))
    del seen, pos
    found = [np.unique((p := near_pairs(t))[off[bucket(p)]]) for t in texts]
    pairs, of = np.unique(np.concatenate(found), return_inverse=True)
    labels = np.repeat(y, [len(f) for f in found])
    count, hits = np.bincount(of, minlength=len(pairs)), np.bincount(of, labels, minlength=len(pairs))
    apart = np.full(len(pairs), np.inf)
    for word in (pairs >> BITS, pairs & (size - 1)):
        r = rate[word]
        apart = np.minimum(apart, np.abs(hits - count * r) / np.sqrt(count * r * (1 - r)))
    apart[count < LEAST] = 0
    best = np.lexsort((pairs, -apart))[:PAIRS]
    best = pairs[best[apart[best] >= STANDS_OUT]]
    return np.unique(np.concatenate([best >> BITS, best & (size - 1)]))


@dataclass
class Machine:
    """slot[id] is a term's row in w and v, or the last row, of zeros."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        rows = self.slot[ids]
        rows = rows[rows < len(self.w) - 1]
        v = self.v[rows]
        z = self.bias + self.w[rows].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(bags: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, n_terms: int = TERMS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """The machine for documents given as sorted distinct term ids and as word ids in their order."""
    size, n, pos = 1 << BITS, len(y), float(np.sum(y))
    blank = Machine(np.full(size, 0, np.int32), 0.0, np.zeros(1), np.zeros((1, factors)))
    if n == 0 or pos in (0, n):
        blank.bias = float(np.log((pos + 0.5) / (n - pos + 0.5))) if n else 0.0
        return blank
    df = np.bincount(np.concatenate(bags), minlength=size).astype(float)
    with_pos = np.bincount(np.concatenate([b for b, t in zip(bags, y) if t]), minlength=size).astype(float)
    expected = df * pos / n
    chi = np.where(df >= 3, (with_pos - expected) ** 2 / np.maximum(expected, 1e-9) / np.maximum(1 - df / n, 1e-9), 0)
    chosen = np.lexsort((np.arange(size), -chi))[:n_terms]
    chosen = np.union1d(chosen[chi[chosen] > 3.84], paired_terms(texts, y))
    k = len(chosen)
    slot = np.full(size, k, np.int32)
    slot[chosen] = np.arange(k)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(k + 1), rng.normal(0, 0.02, (k + 1, factors))
    v[k] = 0
    bias, rate, l2 = float(np.log(pos / (n - pos))), 0.15, 1e-5
    gw, gv, gb = np.full(k + 1, 1e-6), np.full((k + 1, factors), 1e-6), 1e-6
    docs = [(r := slot[b])[r < k] for b in bags]
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            part = order[at : at + 64]
            sizes = [len(docs[i]) for i in part]
            rows = np.concatenate([docs[i] for i in part])
            of = np.repeat(np.arange(len(part)), sizes)
            lin, s = np.bincount(of, w[rows], len(part)), np.zeros((len(part), factors))
            vr = v[rows]
            np.add.at(s, of, vr)
            sq = np.bincount(of, (vr * vr).sum(1), len(part))
            z = bias + lin + 0.5 * ((s * s).sum(1) - sq)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gb += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(gb)
            touched, inverse = np.unique(rows, return_inverse=True)
            dw = np.bincount(inverse, err[of], len(touched)) + l2 * w[touched]
            dv = np.zeros((len(touched), factors))
            np.add.at(dv, inverse, err[of, None] * (s[of] - vr))
            dv += l2 * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
    return Machine(slot, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, seed: int = SEED) -> Machine:
    """Fits in one task, whose rows are bounded by `max_rows` and `max_bytes`; only the machine reaches the driver."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [terms(t.as_py()).tobytes() for t in b.column("text")]
            texts = [word_ids(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bags, pa.binary()), pa.array(texts, pa.binary()), b.column("y")], names=["doc_id", "bag", "words", "y"])

    @tidy
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        machine = fit_rows(pa.Table.from_batches(rows)) if rows else fit([], [], np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], names=["machine"])

    sample = training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, max_rows, max_bytes, seed)
    found = sample.mapInArrow(run, "doc_id bigint, bag binary, words binary, y int").repartition(1).mapInArrow(learn, "machine binary").collect()
    release(docs.sparkSession)
    return pickle.loads(found[0]["machine"]) if found else fit([], [], np.zeros(0))


def fit_rows(rows: pa.Table) -> Machine:
    """The machine for rows of doc_id, bag, words and y, whatever their order."""
    order = pc.sort_indices(rows, [("doc_id", "ascending"), ("words", "ascending")]).to_pylist()
    every = {c: [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column(c)] for c in ("bag", "words")}
    bags, texts = ([every[c][k] for k in order] for c in ("bag", "words"))
    return fit(bags, texts, rows.column("y").to_numpy()[order].astype(float))


def scored(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every document and its score."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)
    out = docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").cast("string").alias("_text"))
    schema = out.drop("_text").schema.add("score", "double")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            scores = pa.array([m.score(terms(t.as_py())) for t in b.column("_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names) if n != "_text"), scores], names=schema.names)

    return out.mapInArrow(run, schema)


def clean(docs: DataFrame, machine: Machine, limit: float = CUT) -> DataFrame:
    """The documents that score below the limit, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shipped.value
        return lambda text: m.score(terms(text)) < limit

    return kept_rows(docs, make)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
