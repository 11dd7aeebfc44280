"""Audio features of a media column: polyphase resampling, log-mel frames and hysteresis energy segments.

A payload is a positive multiple of `BLOCK` bytes, stored losslessly as a WAV file of unsigned 8-bit mono samples at
12 kHz in a media column of a Parquet table. Features come from the stored bytes, read back from there: the samples are
resampled 2:3 to 8 kHz by a polyphase windowed-sinc filter, cut into frames of 256 with a hop of 128, and turned into
24 log-mel bands. A segment starts where the frame energy reaches the upper threshold and ends where it falls below
the lower one (both relative to a noise floor). Every segment is one fixed-shape tensor (`SHAPE`: time bins by bands)
with its time span, kept as an Arrow stream with the extension type fixed_shape_tensor; the feature digests the spans
and tensors as they come out of that stream.

Samples are processed in blocks of `FRAMES` frames, so work space doesn't grow with a text, and equal texts take the
same steps and give equal values. Cases: null and empty texts are one block of blanks, without segments; very long
texts are long payloads, whole; repeated rows get equal values; an empty table gives an empty result; extra columns
are ignored, also those named like a result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, table, utf8

BLOCK, FILL = 192, b" "
RATE, UP, DOWN = 12_000, 2, 3
FRAME, HOP, BANDS, TAPS = 256, 128, 24, 24
FRAMES, SHAPE = 2_048, (8, BANDS)
RISE, FALL = 1.2, 0.6


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and its bytes filled up with blanks."""
    raw = utf8(text)
    return len(raw), raw + FILL * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def to_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def from_wav(media: bytes) -> bytes:
    """Samples of the data chunk of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.cache
def _bank() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase filter (taps by phases), frame window, mel weights."""
    k = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(k / DOWN) / DOWN * np.hamming(len(k)) * UP
    phases = np.stack([h[(p * DOWN) % UP :: UP][::-1] for p in range(UP)], 1)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(60), mel(RATE * UP / DOWN / 2), BANDS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, DOWN / (RATE * UP))[:, None]
    rise, fall = (bins - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - bins) / (hz[2:] - hz[1:-1])
    return phases.astype(np.float32), np.hanning(FRAME + 1)[:-1].astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resampled(samples: np.ndarray) -> np.ndarray:
    """Samples (with TAPS more than the block needs) at 2/3 of the rate: every 3 inputs give 2 outputs."""
    phases, _, _ = _bank()
    windows = np.lib.stride_tricks.sliding_window_view(samples, TAPS + 1)[::DOWN]
    out = np.empty((len(windows), UP), np.float32)
    for p in range(UP):
        shift = (p * DOWN) // UP
        out[:, p] = windows[:, shift : shift + TAPS] @ phases[:, p]
    return out.reshape(-1)


def log_mel(payload: bytes) -> np.ndarray:
    """A row of log-mel energies (dB) for every BLOCK samples."""
    _, window, weights = _bank()
    x = np.frombuffer(payload, np.uint8)
    n = len(x) // BLOCK
    out = np.empty((n, BANDS), np.float32)
    for at in range(0, n, FRAMES):
        size = min(FRAMES, n - at)
        left, right = at * BLOCK - TAPS, (at + size + 1) * BLOCK + TAPS
        part = x[max(0, left) : right].astype(np.float32) / 128 - 1
        part = np.pad(part, (max(0, -left), max(0, right - len(x))))
        y = resampled(part)[(TAPS // DOWN) * UP :]
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:size]
        frames = frames - frames.mean(1, keepdims=True)
        power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
        out[at : at + size] = 10 * np.log10(power.astype(np.float32) @ weights + 1e-6)
    return out


def segments(mel: np.ndarray, rise: float = RISE, fall: float = FALL) -> list[tuple[int, int]]:
    """[first, end) frames that start at floor + rise dB and last until below floor + fall dB."""
    energy = 10 * np.log10(np.mean(10 ** (mel.astype(float) / 10), 1))
    floor = np.quantile(energy, 0.1)
    mark = np.where(energy >= floor + rise, 1, np.where(energy < floor + fall, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[np.maximum(last, 0)] == 1), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def tensors(mel: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mean log-mel of each of SHAPE[0] time bins of every segment, in tenths of a dB."""
    out = np.empty((len(spans), *SHAPE), np.float32)
    for k, (a, b) in enumerate(spans):
        cuts = a + np.arange(SHAPE[0] + 1) * (b - a) // SHAPE[0]
        total = np.vstack([np.zeros((1, BANDS)), np.cumsum(mel[a:b].astype(float), 0)])
        lo, hi = cuts[:-1] - a, np.maximum(cuts[1:], cuts[:-1] + 1) - a
        out[k] = np.round(10 * (total[hi] - total[lo]) / (hi - lo)[:, None]) / 10
    return out


def to_arrow(spans: list[tuple[int, int]], values: np.ndarray) -> bytes:
    """An Arrow stream of start_ms, end_ms and a fixed-shape tensor for each segment."""
    ms = 1000 * BLOCK // RATE
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), SHAPE[0] * SHAPE[1])
    batch = pa.record_batch([pa.array([a * ms for a, _ in spans], pa.int64()), pa.array([b * ms for _, b in spans], pa.int64()), pa.ExtensionArray.from_storage(kind, flat)], names=["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_arrow(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start_ms, end_ms) rows and tensors of `to_arrow`."""
    found = pa.ipc.open_stream(stream).read_all().combine_chunks()
    spans = np.stack([found.column(c).to_numpy() for c in ("start_ms", "end_ms")], 1) if found.num_rows else np.zeros((0, 2), np.int64)
    flat = [c.storage.flatten().to_numpy() for c in found.column("log_mel").chunks]
    return spans, np.concatenate(flat or [np.zeros(0, np.float32)]).reshape(-1, *SHAPE)


def feature_of(stream: bytes) -> str:
    """Number of segments, their milliseconds and a digest of spans and tensors, from the stored stream."""
    spans, values = from_arrow(stream)
    digest = hashlib.sha256(spans.astype("<i8").tobytes() + np.round(values.astype(float) * 10).astype("<i4").tobytes())
    return f"{len(spans)}:{int((spans[:, 1] - spans[:, 0]).sum())}:{digest.hexdigest()[:32]}"


def _mapped(df: DataFrame, gone: str, fields: list[tuple[str, str, pa.DataType]], row) -> DataFrame:
    """`df` with the column `gone` replaced by the fields that `row` makes of its values."""
    schema = df.drop(gone).schema
    for name, kind, _ in fields:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                rows = [row(t.as_py()) for t in b.column(gone)]
                yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names) if n != gone), *(pa.array(c, t) for c, (*_, t) in zip(zip(*rows), fields))], names=schema.names)

    return df.mapInArrow(run, schema)


def stored(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, n_bytes and the payload's WAV file as `media`, written to the shared folder and read from there."""

    def row(value: str | None) -> tuple[int, bytes]:
        n, payload = payload_of(value)
        return n, to_wav(payload)

    out = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string").alias("_text"))
    path = fresh_dir(docs.sparkSession, "media")
    _mapped(out, "_text", [("n_bytes", "long", pa.int64()), ("media", "binary", pa.binary())], row).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def features(media: DataFrame, with_media: bool = False) -> DataFrame:
    """The contract's figures of the payload in `media`, its segments, their tensors as an Arrow stream, and the feature."""

    def row(wav: bytes) -> tuple:
        back = from_wav(wav)
        mel = log_mel(back)
        spans = segments(mel)
        stream = to_arrow(spans, tensors(mel, spans))
        return (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), feature_of(stream), len(spans), stream, *[wav] * with_media)

    fields = [("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("n_segments", "long", pa.int64()), ("tensors", "binary", pa.binary())]
    return _mapped(media, "media", fields + [("media", "binary", pa.binary())] * with_media, row)


def audio_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_media: bool = False) -> DataFrame:
    """Stores every text as a WAV file and computes the features of what is read back."""
    return features(stored(docs, keep, text), with_media)


def op3_audio(spark, sf_dir: str) -> DataFrame:
    return audio_features(table(spark, sf_dir, "documents"))
