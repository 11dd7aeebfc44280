"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

The whole text is cut into passages of `PASSAGE` words. A passage is encoded by a learned layer over the mean of its
words' embeddings (lower-cased words hashed to 2^`BITS` learned vectors) and over rates of its characters and words
(case, punctuation, symbols, digits, repetition, word lengths), and weighted by gated attention
``softmax(u . (tanh(V h) * sigmoid(U h)))``; the score is the logistic of a linear function of the weighted sum of
passage codes. Only document labels are given, the attention learns which passages decide. Trained by Adam on the
driver on a bounded sample (about `max_rows` labelled rows outside the held-out fold and `max_bytes` bytes of text,
each row with its whole text); labels, lang, source and doc_id are never inputs.

Cases: null and empty texts are one passage without words; very long texts are many passages, all of which count;
without labelled rows every score is 0.5, with labels of one class only the smoothed rate of that class; repeated
documents score alike; null ids count as not held out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, utf8
from .learning import fold, training_sample

PASSAGE = 48
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
MAX_ROWS, MAX_BYTES, HIDDEN, GATE, EPOCHS, SEED = 8_000, 32 << 20, 16, 8, 12, 11
BITS, CACHE = 14, 100_000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:?'\"()-"
SYMBOLS = b"#$%&*@^~=<>{}[]\\/+_`"
HIGH = bytes(range(128, 256))
WIDTH = 15


def passages(text: str | None) -> np.ndarray:
    """A row of features for every passage of the text."""
    w = utf8(text).split()
    out = np.zeros((max(1, -(-len(w) // PASSAGE)), WIDTH))
    before: set[bytes] = set()
    for k in range(len(out) if w else 0):
        part = w[k * PASSAGE : (k + 1) * PASSAGE]
        n, flat = len(part), b"".join(part)
        size, kinds = len(flat), set(part)
        count = lambda chars: size - len(flat.translate(None, chars))  # noqa: B023, E731
        lengths = [len(x) for x in part]
        out[k] = (
            np.log1p(n), count(UPPER) / size, count(LOWER) / size, count(DIGITS) / size, count(STOPS) / size, count(SYMBOLS) / size, count(HIGH) / size,
            flat.count(b"!") / n, flat.count(b"|") / n, len(kinds) / n, sum(a == b for a, b in zip(part, part[1:])) / n,
            size / n, max(lengths) / 20, sum(x == 1 for x in lengths) / n, len(kinds & before) / len(kinds),
        )
        before |= kinds
    return out


class WordIds(dict):
    """Hashed id of a lower-cased word; starts anew when it holds many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = zlib.crc32(word.lower()) >> (32 - BITS)
        return found


_ids = WordIds()


def word_ids(text: str | None) -> np.ndarray:
    """Ids of the words of the text; word i is in passage i // PASSAGE."""
    w = utf8(text).split()
    return np.fromiter(map(_ids.__getitem__, w), np.int32, len(w))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Bag:
    """The network; `p` holds its arrays by name."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    std: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float = 0.5

    def forward(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray, words: np.ndarray, place: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages of the documents, whose first passages are at `starts`; words, their passages, and the words in these."""
        p = self.p
        pre = x @ p["W"] + p["w0"]
        if len(words):
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            pre[place[first]] += np.add.reduceat(p["E"][words], first) / share[place[first], None]
        h = np.tanh(pre)
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["u"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def _of(self, text: str | None) -> dict[str, np.ndarray]:
        rows, words = passages(text), word_ids(text)
        x, place = np.clip((rows - self.mean) / self.std, -8, 8), np.arange(len(words)) // PASSAGE
        return self.forward(x, np.zeros(1, int), np.zeros(len(x), int), words, place, np.maximum(1, np.bincount(place, minlength=len(x))))

    def score(self, text: str | None) -> float:
        return float(self._of(text)["y"][0]) if self.p else self.constant

    def attention(self, text: str | None) -> np.ndarray:
        """The weight of each passage of a document."""
        return self._of(text)["a"]


def gradients(net: Bag, y: np.ndarray, x: np.ndarray, starts: np.ndarray, of: np.ndarray, words: np.ndarray, place: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss, by array."""
    p, r = net.p, net.forward(x, starts, of, words, place, share)
    dz0 = (r["y"] - y) / len(y)
    g = {"c": r["z"].T @ dz0, "c0": dz0.sum()}
    dz = dz0[:, None] * p["c"]
    da = (dz[of] * r["h"]).sum(1)
    de = r["a"] * (da - np.add.reduceat(r["a"] * da, starts)[of])
    g["u"] = (r["t"] * r["s"]).T @ de
    dts = de[:, None] * p["u"]
    dt, ds = dts * r["s"] * (1 - r["t"] ** 2), dts * r["t"] * r["s"] * (1 - r["s"])
    g["V"], g["U"] = r["h"].T @ dt, r["h"].T @ ds
    dh = r["a"][:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T
    dh *= 1 - r["h"] ** 2
    g["W"], g["w0"] = x.T @ dh, dh.sum(0)
    each = dh / share[:, None]
    g["E"] = np.stack([np.bincount(words, column[place], len(p["E"])) for column in each.T], 1)
    return g


def fit(bags: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Bag:
    """The network for documents given as passages' rates and as word ids in their order."""
    n, pos = len(y), float(np.sum(y))
    if n == 0 or pos in (0, n):
        return Bag(constant=(pos + 0.5) / (n + 1))
    every = np.concatenate(bags)
    net = Bag(every.mean(0), every.std(0) + 1e-6)
    x = np.clip((every - net.mean) / net.std, -8, 8)
    sizes, lengths = np.array([len(b) for b in bags]), np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    net.p = p = {"W": draw(WIDTH, HIDDEN), "w0": np.zeros(HIDDEN), "E": rng.normal(0, 0.01, (1 << BITS, HIDDEN)), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "u": draw(GATE), "c": draw(HIDDEN), "c0": np.array(0.0)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            part = order[at : at + 64]
            of = np.repeat(np.arange(len(part)), sizes[part])
            starts = np.cumsum(sizes[part]) - sizes[part]
            rows = np.arange(len(of)) - starts[of] + first[part][of]
            words = np.concatenate([texts[i] for i in part])
            place = np.concatenate([np.arange(k) // PASSAGE + s for k, s in zip(lengths[part], starts)])
            share = np.maximum(1, np.bincount(place, minlength=len(of)))
            g = gradients(net, y[part], x[rows], starts, of, words, place, share)
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k in p:
                d = g[k] + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.p = {k: a.astype(np.float32) for k, a in p.items()}
    return net


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, seed: int = SEED) -> Bag:
    """Fits on the driver; what it collects is bounded by `max_rows` and `max_bytes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [passages(t.as_py()).astype("<f4").tobytes() for t in b.column("text")]
            texts = [word_ids(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bags, pa.binary()), pa.array(texts, pa.binary()), b.column("y")], names=["doc_id", "bag", "words", "y"])

    sample = training_sample(docs, labels, "quality", FOLDS, HELD_OUT, max_rows, max_bytes, seed)
    rows = sample.mapInArrow(run, "doc_id bigint, bag binary, words binary, y int").toArrow().sort_by([("doc_id", "ascending"), ("bag", "ascending"), ("words", "ascending")])
    bags = [np.frombuffer(x.as_buffer(), "<f4").reshape(-1, WIDTH).astype(float) for x in rows.column("bag")]
    return fit(bags, [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("words")], rows.column("y").to_numpy().astype(float))


def scored(docs: DataFrame, net: Bag, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every document and its score."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    out = docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").cast("string").alias("_text"))
    schema = out.drop("_text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = shipped.value
        for b in batches:
            scores = pa.array([bag.score(t.as_py()) for t in b.column("_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names) if n != "_text"), scores], names=schema.names)

    return out.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
