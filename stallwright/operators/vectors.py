"""Vectors: normalisation, cosine, exact k nearest neighbours in blocks, calibrated pair scores, metrics, TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ensemble weights of logit difference and similarity, and the intercept (fixed values).
ENSEMBLE = (2.4910, 0.4324, -2.6254)
#: Queries that go to the tasks at a time; more are taken in further passes over the corpus.
QUERY_BLOCK = 4096
#: Numbers (rows times dimension) in a block of top_pairs; rows and columns of a product; pairs scored at a time.
BLOCK_VALUES = 1 << 21
TILE_ROWS, TILE_COLUMNS = 1024, 4096
SCORED = 8192
#: Above every id.
FAR = np.iinfo(np.int64).max


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def knn(corpus: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, drop_self: bool = False) -> DataFrame:
    """(query, id, score, rank): the k most similar rows of the corpus for each query, ties by id.

    Both frames have id and v. Queries are taken `block` at a time, a bounded matrix that every task multiplies with
    its share of the corpus; only k rows for each query and task are shuffled.
    """
    total = queries.count()
    parts = max(1, -(-total // block))
    out = None
    for part in range(parts):
        some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        rows = [(r.id, r.v) for r in some.select("id", F.col("v").cast("array<double>").alias("v")).toLocalIterator()]
        shipped = corpus.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), -1)))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q = shipped.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
            best_s, best_i = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                v = np.array(b.column(1).to_pylist(), float)
                s = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)).T
                own = np.broadcast_to(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), s.shape)
                if drop_self:
                    s = np.where(own == np.array(ids)[:, None], -np.inf, s)
                s, own = np.hstack([best_s, s]), np.hstack([best_i, own])
                top = np.lexsort((own, -np.round(s, 12)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, top, 1), np.take_along_axis(own, top, 1)
            keep = np.isfinite(best_s)
            n = keep.sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(best_i[keep]), pa.array(best_s[keep])], names=["query", "id", "score"])

        found = corpus.select(F.col("id").cast("bigint"), F.col("v").cast("array<double>")).mapInArrow(run, "query bigint, id bigint, score double")
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
    return out.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


class _Vectors:
    """Rows of a block: distinct vectors by their smallest ids, and the ids of each."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order] + 0.0  # -0.0 becomes 0.0
        seen: dict[bytes, int] = {}
        kind = np.array([seen.setdefault(x.tobytes(), len(seen)) for x in v], int)
        at = np.argsort(kind, kind="stable")
        starts = np.flatnonzero(np.diff(kind[at], prepend=-1))
        self.ids = np.split(ids[at], starts[1:])
        self.v = v[at[starts]]
        self.first = ids[at[starts]]
        self.second = np.array([x[n] if (n := np.searchsorted(x, x[0], "right")) < len(x) else FAR for x in self.ids], np.int64)
        with np.errstate(all="ignore"):
            self.square = sum((x * x for x in self.v.T), np.zeros(len(self.v)))
            self.odd = ~(np.isfinite(self.square) & (self.square > 0))
            self.unit = np.where(self.odd[:, None], 0.0, self.v / np.sqrt(self.square)[:, None])


def _cosines(a: _Vectors, b: _Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines summed and clamped as DuckDB does, to the last bit; what is NaN there is inf."""
    with np.errstate(all="ignore"):
        s = sum((x * y for x, y in zip(a.v[i].T, b.v[j].T)), np.zeros(len(i))) / np.sqrt(a.square[i] * b.square[j])
    return np.where(np.isnan(s), np.inf, np.clip(s, -1.0, 1.0))


def _rounded(s: np.ndarray, digits: int, nudge: float) -> np.ndarray:
    """Halves away from zero, as DuckDB rounds."""
    s = s + nudge
    return np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits, s)


def _best_pairs(a: _Vectors, b: _Vectors, k: int, floor: float, digits: int, nudge: float) -> list[tuple[int, int, float]]:
    """The first k pairs of a row of a and one of b by (rounded cosine descending, ids); b may be a itself.

    Pairs of distinct vectors are ranked by their cosine and first pair of ids. Only those that the product, with its
    error bound, leaves possible are scored; the first k hold the first k pairs of ids.
    """
    eps = 4 * (a.v.shape[1] + 8) * np.finfo(float).eps
    half, top = 0.5 / 10.0**digits, _rounded(np.ones(1), digits, nudge)[0]
    least = lambda z: z - half - nudge - 2 * eps  # noqa: E731  a product below can't round to z
    s, p, q, i, j = np.zeros(0), *(np.zeros(0, np.int64) for _ in range(4))
    last, at = -np.inf, (FAR, FAR)  # the k-th so far: its rounded cosine and ids
    for r in range(0, len(a.v), TILE_ROWS):
        rows = slice(r, r + TILE_ROWS)
        for c in range(r if a is b else 0, len(b.v), TILE_COLUMNS):
            columns = slice(c, c + TILE_COLUMNS)
            odd = a.odd[rows].any() or b.odd[columns].any()
            if last >= (np.inf if odd else top) and min(a.first[r], b.first[c]) > at[0]:
                continue  # at most ties, and later ones
            near = a.unit[rows] @ b.unit[columns].T
            near[a.odd[rows]] = np.inf
            near[:, b.odd[columns]] = np.inf
            if a is b and c == r:
                near[np.tril_indices(len(near), -1, near.shape[1])] = -np.inf
            if len(np.intersect1d(a.first[rows], b.first[columns])):
                x, y = np.nonzero(a.first[rows, None] == b.first[None, columns])
                lone = np.minimum(a.second[rows][x], b.second[columns][y]) == FAR
                near[x[lone], y[lone]] = -np.inf  # one id only
            some = np.flatnonzero(near >= max(floor - eps, least(last)))
            near = near.ravel()
            if len(some) > k:
                kth = np.partition(near[some], -k)[-k :][:1] - eps
                some = some[near[some] >= least(_rounded(kth, digits, nudge)[0])]
            width = min(TILE_COLUMNS, len(b.v) - c)
            for part in range(0, len(some), SCORED):
                few = some[part : part + SCORED]
                few = few[near[few] >= least(last)]
                u, v = few // width + r, few % width + c
                x, y = a.first[u], b.first[v]
                low, high = np.minimum(x, y), np.where(x != y, np.maximum(x, y), np.minimum(a.second[u], b.second[v]))
                ahead = (near[few] >= last + half - nudge - 2 * eps) | (low < at[0]) | (low == at[0]) & (high < at[1])
                u, v, low, high = u[ahead], v[ahead], low[ahead], high[ahead]
                score = _cosines(a, b, u, v)
                above = score > floor
                score = _rounded(score, digits, nudge)
                s, p, q, i, j = (np.concatenate(z) for z in ((s, score[above]), (p, low[above]), (q, high[above]), (i, u[above]), (j, v[above])))
                best = np.lexsort((q, p, -s))[:k]
                s, p, q, i, j = s[best], p[best], q[best], i[best], j[best]
                if len(s) == k:
                    last, at = s[-1], (p[-1], q[-1])
    found = []
    for score, u, v in zip(s.tolist(), i, j):
        own = a is b and u == v
        found += [(-score, min(x, y), max(x, y)) for x in a.ids[u].tolist() for y in b.ids[v].tolist() if (x < y if own else x != y)]
    return [(x, y, float("nan") if score == -np.inf else -score) for score, x, y in sorted(found)[:k]]


def top_pairs(rows: DataFrame, k: int, floor: float, digits: int, nudge: float = 0.0, values: int = BLOCK_VALUES) -> DataFrame:
    """(a, b, s): the first k pairs a < b of rows (id, v, label) of equal labels by (s descending, a, b).

    s is the cosine plus `nudge`, rounded; the cosine itself is above `floor`. It equals DuckDB's to the last bit. A vector
    that is zero or not finite gives NaN, which stands above all numbers. Vectors of unequal lengths, empty ones and those
    with null elements have no cosine.

    Every pair is looked at: a label's rows are dealt by their vectors into blocks of about `values` numbers, and a group
    multiplies two blocks in tiles. A row goes to as many groups as its label has blocks; a group gives k rows. Of equal
    vectors, those after the k + 1 smallest ids can't be in the first k pairs and stay behind before the shuffle.
    """
    known = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    rows = rows.where(known).select("label", F.size("v").alias("dim"), F.col("id").cast("bigint").alias("id"), "v")
    large = rows.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") * F.col("dim") / values).alias("blocks")).where("blocks > 1")
    place = F.dense_rank().over(Window.partitionBy("label", "v").orderBy("id"))
    first = rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    dealt = first.join(F.broadcast(large), ["label", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    keys = ["label", "dim", "i", "j"]
    dealt = dealt.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, i, j = (x.as_py() for x in key[1:])
        own, ids = table["own"].to_numpy(), table["id"].to_numpy()
        v = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table["v"].chunks]).astype(float).reshape(-1, dim)
        a = _Vectors(ids[own == i], v[own == i])
        b = a if i == j else _Vectors(ids[own == j], v[own == j])
        found = _best_pairs(a, b, k, floor, digits, nudge)
        return pa.table([pa.array([x[n] for x in found], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "s"])

    found = dealt.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, "a bigint, b bigint, s double")
    return found.orderBy(F.desc("s"), "a", "b").limit(k)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ensemble_score(logit: Column, similarity: Column) -> Column:
    """Calibrated probability of a comparable pair."""
    w1, w2, b = ENSEMBLE
    return sigmoid(w1 * logit + w2 * similarity + b)


def softmax2(a: Column, b: Column) -> dict[str, Column]:
    """Stable softmax of two logits: argmax, its probability, and the difference."""
    top = F.greatest(a, b)
    ea, eb = F.exp(a - top), F.exp(b - top)
    return {"label": F.when(b > a, 1).otherwise(0), "probability": F.greatest(ea, eb) / (ea + eb), "difference": b - a}


def verdict(answer: Column) -> tuple[Column, Column]:
    """(comparable, confidence) of same, different, uncertain or nothing."""
    a = F.lower(answer)
    return F.coalesce(a == "same", F.lit(False)), F.when(a.isin("same", "different"), 1.0).when(a == "uncertain", 0.5).otherwise(0.0)


def binary_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, F1, and macro F1, precision and recall of (label, predicted); macro F1 is null where labels have one class.

    Precision and recall average over the classes that occur among labels or predictions.
    """
    y, p = F.col("label"), F.col("predicted")
    n = lambda c: F.count_if(c).cast("double")
    g = rows.groupBy(*by).agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    ones, zeros = (tp + fp + fn > 0).cast("double"), (tn + fp + fn > 0).cast("double")
    macro = lambda one, zero: (one * ones + zero * zeros) / (ones + zeros)
    return g.select(
        *by,
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        f1.alias("f1"),
        F.when((tp + fn > 0) & (tn + fp > 0), (f1 + f0) / 2).alias("f1_macro"),
        macro(ratio(tp, tp + fp), ratio(tn, tn + fn)).alias("precision_macro"),
        macro(ratio(tp, tp + fn), ratio(tn, tn + fp)).alias("recall_macro"),
    )


def tfidf(terms: DataFrame, min_df: int = 5, max_df_ratio: float = 0.8) -> DataFrame:
    """(doc, term, weight) from (doc, term) places: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows of unit length."""
    tf = terms.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    n = terms.agg(F.countDistinct("doc").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df_ratio * F.col("n")))
    w = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    rows = tf.join(df, "term").select("doc", "term", w.alias("w"))
    return rows.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))).drop("w")
