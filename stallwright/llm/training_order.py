"""Training-order materialisation: a keyed Feistel permutation gives every token sequence its global slot.

Documents become token ids with an end-of-text id, cut into sequences of `LENGTH` ids, the last one filled up. Two
passes go over the texts. The first counts the sequences of each task, N in all, so that they have numbers without a
gap; it also keeps where tokens end (a bit for each byte), from which the second pass gets the ids without encoding
again. A balanced Feistel network over the smallest even number of bits that holds N, walked until it lands below N
(cycle-walking), maps the numbers one to one on the slots 0 to N - 1. A shard is a range of as many slots as fit in
`SHARD_BYTES` (more where `MOST_SHARDS` shards would not do); its task gets it whole, sorts it by slot and writes records of equal length.

A shard is a file of little-endian ids, 16 bits where the vocabulary allows, under a name no other attempt uses; the
manifest (shard, file, first slot, count) is what a reader needs to seek to any slot: byte ``(slot - first) *
stride``. Checksums are those of the records read back. `read` continues from any slot. Only files named by finished
tasks are in the manifest, so lost executors leave nothing wrong behind. Both passes must see the same partitions, as
`zipWithIndex` asks for too; the second compares them with the first and fails if they differ, it never misplaces.

Cases: null and empty texts are one sequence with the end-of-text id; repeated rows are sequences of their own; very
long texts are many sequences; an empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir, table
from .tokenizer import encoder, id_type, token_bytes
from .warc_merge import filesystem

LENGTH, EOT, KEY, ROUNDS = 512, 0, 20240229, 6
SHARD_BYTES, MOST_SHARDS = 16 << 20, 100_000


def round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(rounds)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, size: int, keys: list[int]) -> np.ndarray:
    """The permutation of [0, size) applied to x."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        y = out[todo]
        left, right = y >> shift, y & low
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & low)
        y = (left << shift) | right
        out[todo] = y
        todo = todo[y >= size]
    return out


def restored(x: np.ndarray, size: int, keys: list[int]) -> np.ndarray:
    """The inverse of `permuted`."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        y = out[todo]
        left, right = y >> shift, y & low
        for k in reversed(keys):
            left, right = right ^ (_mix(left, k) & low), left
        y = (left << shift) | right
        out[todo] = y
        todo = todo[y >= size]
    return out


SLOT_BITS, _FULL = 20, (1 << 64) - 1


def _codes(eight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for up to eight bytes and their count, of which few share their upper bits; each step can be undone."""
    x = (eight ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Cuts:
    """The tokens of a task's texts as a file of one bit for each byte, set where a token ends; a sixth of the ids' size."""

    def __init__(self, path: str, known: dict[bytes, int]):
        self.known, self.size = known, np.zeros(max(known.values()) + 1, np.int64)
        for token, k in known.items():
            self.size[k] = len(token)
        self.fs, self.at = filesystem(path)
        short = [t for t in known if len(t) <= 8]
        codes = _codes(np.array([int.from_bytes(t, "little") for t in short], np.uint64), np.array([len(t) for t in short]))
        self.ids = np.array([known[t] for t in short], np.uint32)
        self.codes, self.slots = codes, np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[codes >> np.uint64(64 - SLOT_BITS)] = np.arange(len(short))

    def open_output(self) -> None:
        self.fs.create_dir(self.at.rsplit("/", 1)[0], recursive=True)
        self.file, self.packer = self.fs.open_output_stream(self.at, compression=None), zlib.compressobj(1)

    def put(self, raw: bytes, ids: np.ndarray) -> None:
        ends, bits = np.cumsum(self.size[ids]), np.zeros(len(raw), np.uint8)
        if len(raw) != (ends[-1] if len(ends) else 0):
            raise ValueError("the ids do not spell the text out")
        bits[ends - 1] = 1
        self.file.write(self.packer.compress(np.packbits(bits).tobytes()))

    def close_output(self) -> None:
        self.file.write(self.packer.flush())
        self.file.close()

    def open_input(self) -> None:
        self.file, self.unpacker, self.rest = self.fs.open_input_stream(self.at, compression=None), zlib.decompressobj(), b""

    def get(self, raw: bytes) -> np.ndarray:
        """Ids of the next text; fails if the text isn't the one that was put."""
        n = -(-len(raw) // 8)
        while len(self.rest) < n:
            data = self.file.read(1 << 18)
            if not data:
                raise ValueError("the input changed between the passes over it")
            self.rest += self.unpacker.decompress(data)
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(self.rest[:n], np.uint8))) + 1
        self.rest = self.rest[n:]
        if len(raw) != (ends[-1] if len(ends) else 0):
            raise ValueError("the input changed between the passes over it")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        sizes = ends - starts
        eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))[starts]
        few = np.minimum(sizes, 8)
        codes = _codes(eight & (np.uint64(_FULL) >> (np.uint64(64) - few.astype(np.uint64) * np.uint64(8))), few)
        at = self.slots[codes >> np.uint64(64 - SLOT_BITS)]
        out = self.ids[at]
        try:
            for k in np.flatnonzero((self.codes[at] != codes) | (sizes > 8)).tolist():
                out[k] = self.known[raw[starts[k] : ends[k]]]
        except KeyError:
            raise ValueError("the input changed between the passes over it") from None
        return out


def numbered(rows: DataFrame, tokenizer_path: str, folder: str, length: int) -> list[tuple[int, str | None, int]]:
    """First pass: (task, file of its token ends, sequences of its texts); the driver gets one row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, task, n = encoder(tokenizer_path), token_bytes(tokenizer_path), TaskContext.get().partitionId(), 0
        name = f"{folder}/cuts-{task:06d}-{uuid.uuid4().hex}.bin" if known else None
        cuts = Cuts(name, known) if known else None
        if cuts:
            cuts.open_output()
        for b in batches:
            for t in b.column("text"):
                ids = encode(t.as_py() or "")
                n += len(ids) // length + 1
                if cuts:
                    cuts.put((t.as_py() or "").encode(), ids)
        if cuts:
            cuts.close_output()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([name], pa.string()), pa.array([n], pa.int64())], names=["task", "file", "n"])

    return sorted((r.task, r.file, r.n) for r in rows.mapInArrow(run, "task int, file string, n bigint").collect())


def materialise(docs: DataFrame, tokenizer_path: str, folder: str, *, length: int = LENGTH, eot: int = EOT, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Writes the shards; a row for each sequence (doc_id, seq, n_ids, crc32, slot, shard, place) and the manifest."""
    spark, keys, kind = docs.sparkSession, round_keys(key), np.dtype(id_type(tokenizer_path))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = numbered(rows, tokenizer_path, folder, length)
    total, stride = sum(n for *_, n in tasks), kind.itemsize * length
    each = max(1, shard_bytes // stride, -(-total // MOST_SHARDS))
    shards = max(1, -(-total // each))
    first = np.cumsum([0, *(n for *_, n in tasks)]).tolist()
    ranges = {task: (file, first[k], n) for k, (task, file, n) in enumerate(tasks)}
    shipped = spark.sparkContext.broadcast(ranges)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, squeeze = encoder(tokenizer_path), token_bytes(tokenizer_path), zstandard.ZstdCompressor(level=1).compress
        file, number, share = shipped.value.get(TaskContext.get().partitionId(), (None, 0, 0))
        last = number + share
        cuts = Cuts(file, known) if file else None
        if cuts:
            cuts.open_input()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b, doc, seq, used, data = whole.slice(at, 500), [], [], [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                    text = t.as_py() or ""
                    ids = np.append(cuts.get(text.encode()) if cuts else encode(text), eot).astype(kind)
                    for k in range(0, len(ids), length):
                        part = ids[k : k + length]
                        doc.append(d)
                        seq.append(k // length)
                        used.append(len(part))
                        data.append(squeeze(part.tobytes()))
                if number + len(doc) > last:
                    raise ValueError("the input changed between the passes over it")
                slot = permuted(np.arange(number, number + len(doc)), total, keys).astype(np.int64)
                number += len(doc)
                yield pa.RecordBatch.from_arrays([pa.array((slot // each).astype(np.int32)), pa.array(slot), pa.array(doc, pa.int64()), pa.array(seq, pa.int64()), pa.array(used, pa.int64()), pa.array(data, pa.binary())], names=["shard", "slot", "doc_id", "seq", "n_ids", "ids"])
        if number != last:
            raise ValueError("the input changed between the passes over it")

    dealt = rows.mapInArrow(sequences, "shard int, slot bigint, doc_id bigint, seq bigint, n_ids bigint, ids binary")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, name, expected, meta, unpack = None, "", 0, [], zstandard.ZstdDecompressor().decompress
        for b in batches:
            shard, slots = b.column("shard").to_pylist(), b.column("slot").to_pylist()
            if sink is None and slots:
                name, expected = f"{folder}/shard-{shard[0]:06d}-{uuid.uuid4().hex}.bin", shard[0] * each
                fs, path = filesystem(name)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = fs.open_output_stream(path, compression=None)
            for slot, packed in zip(slots, b.column("ids")):
                if slot != expected:
                    raise ValueError(f"slot {slot} came where {expected} belongs")
                data = unpack(packed.as_py())
                sink.write(data + np.full((stride - len(data)) // kind.itemsize, eot, kind).tobytes())
                expected += 1
            meta.append(b.select(["shard", "slot", "doc_id", "seq", "n_ids"]))
        if sink is None:
            return
        sink.close()
        with fs.open_input_stream(path, compression=None) as f:
            for b in meta:
                crc = [zlib.crc32(f.read(stride)[: n * kind.itemsize]) for n in b.column("n_ids").to_pylist()]
                place = pa.array(b.column("slot").to_numpy() % each)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([name] * len(crc), pa.string()), place, pa.array(crc, pa.int64())], names=[*b.schema.names, "file", "place", "crc32"])

    placed = cut(dealt.mapInArrow(write, "shard int, slot bigint, doc_id bigint, seq bigint, n_ids bigint, file string, place bigint, crc32 bigint"))
    manifest = placed.groupBy("shard", "file").agg(F.min("slot").alias("first"), F.count("*").alias("count"))
    return placed.select("doc_id", "seq", "n_ids", "crc32", "slot", "shard", "place"), manifest


def read(manifest: list[tuple[int, str, int, int]], slot: int, count: int, length: int = LENGTH, kind: str = "<u2") -> Iterator[np.ndarray]:
    """`count` sequences from `slot` on, as a training job resumes: one seek, then sequential reads."""
    stride = np.dtype(kind).itemsize * length
    for _, file, first, n in sorted(manifest, key=lambda m: m[2]):
        if count and first <= slot < first + n:
            fs, path = filesystem(file)
            with fs.open_input_file(path) as f:
                f.seek((slot - first) * stride)
                while count and slot < first + n:
                    yield np.frombuffer(f.read(stride), kind)
                    slot, count = slot + 1, count - 1


def op6_training_order(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_dir(spark, "order"))[0]
