"""Best-fit packing of token sequences by large-item matching.

Documents above a third of the capacity go at most two to a bin, matched greedily: the largest left takes the
largest partner that still fits. The others fill the remaining gaps best-fit, in decreasing length. Lengths are
integers up to the capacity, so the plan needs only the number of pieces of each length: a histogram of at most
`capacity` rows on the driver, whatever the size of the corpus. The plan is a list of bin patterns, each with the
number of bins it stands for; pieces of a length find their bin by their rank among the pieces of that length.
Ranks come from counts by (task, length), so no group of pieces ever meets in one task.

Cases: null and empty texts are the end-of-text id alone; repeated rows are packed each for itself; an empty table
gives an empty result; extra columns are ignored. Only documents longer than the capacity are cut, into full
pieces; the first piece takes the remainder. Lone surrogates cannot occur in UTF-8 columns.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy
from .tokenizer import encoder

CAPACITY = 2048
EOT = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eot: int = EOT) -> DataFrame:
    """Token pieces of every document, each with its task and its place among the task's pieces of its length."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            out: list[tuple] = []
            texts = b.column(1)
            for doc, text in zip(b.column(0).to_pylist(), texts):
                ids = np.append(np.asarray(encode(text.as_py() or ""), "<u4"), np.uint32(eot)).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if k == 0 else start + capacity]
                    out.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class Bins:
    """`count` bins filled alike; slots are (length, pieces of it in a bin, rank of the first one, offset in the bin)."""

    __slots__ = ("count", "gap", "slots")

    def __init__(self, count: int, gap: int, slots: list[tuple[int, int, int, int]]):
        self.count, self.gap, self.slots = count, gap, slots

    def split(self, n: int) -> Bins:
        """Takes the first n bins out."""
        head = Bins(n, self.gap, list(self.slots))
        self.slots = [(ln, k, r + n * k, o) for ln, k, r, o in self.slots]
        self.count -= n
        return head


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for counts[length] pieces of each length."""
    left, used = dict(counts), dict.fromkeys(counts, 0)
    by_gap: dict[int, list[Bins]] = {}

    def put(bins: Bins, length: int, k: int) -> None:
        bins.slots.append((length, k, used[length], capacity - bins.gap))
        used[length] += k * bins.count
        left[length] -= k * bins.count
        bins.gap -= k * length
        by_gap.setdefault(bins.gap, []).append(bins)

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect_right(large, min(a, capacity - a)) - 1
            while i >= 0 and (not left[large[i]] or large[i] == a and left[a] < 2):
                i -= 1
            b = large[i] if i >= 0 else 0
            if not b:
                put(Bins(left[a], capacity, []), a, 1)
            elif b == a:
                put(Bins(left[a] // 2, capacity, []), a, 2)
            else:
                pair = Bins(min(left[a], left[b]), capacity, [])
                put(pair, a, 1)
                by_gap[pair.gap].remove(pair)
                put(pair, b, 1)
    for a in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        gap = a
        while left[a]:
            while gap < capacity and not by_gap.get(gap):
                gap += 1
            bins = by_gap[gap].pop() if by_gap.get(gap) else Bins(-(-left[a] // (capacity // a)), capacity, [])
            k = bins.gap // a
            full = min(bins.count, left[a] // k)
            rest = bins
            if full:
                rest = bins if full < bins.count else None
                put(bins.split(full) if rest else bins, a, k)
            if rest and left[a]:
                last = rest.split(1) if rest.count > 1 else rest
                rest = None if last is rest else rest
                put(last, a, left[a])
            if rest:
                by_gap.setdefault(rest.gap, []).append(rest)
    return [b for g in by_gap.values() for b in g if b.slots]


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eot: int = EOT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cutted = cut(pieces(docs, tokenizer_path, capacity, eot))
    counts = cutted.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    bins = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    rows, base = [], 0
    for b in bins:
        rows += [(ln, r, k, base, o) for ln, k, r, o in b.slots]
        base += b.count
    rows.sort()
    shipped = docs.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shipped.value
        keys = (at[:, 0] << 44) + at[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = at[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            seq, off = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    ranked = cutted.join(starts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
