"""WARC archives of captured pages and an external merge of their indexes.

Every page becomes one record of a gzip-per-record WARC archive. Of pages with equal payloads of at least
`MIN_BYTES` bytes, the one with the smallest page_id is a response, the others are revisits that refer to it and state
its payload's digest and length; all smaller payloads are responses. Each writing task closes an archive at
`ARCHIVE_BYTES` and sorts at most `RUN_ROWS` index entries at a time into a run: a Parquet file ordered by URL key,
timestamp and page. The runs are merged by loser trees: each merge task owns a range of keys, reads only the row
groups of the runs that overlap it, and streams the captures out in order. With more than `FAN_IN` runs, groups of
them are merged into longer runs first, each group by as many tasks as its rows ask for, again by ranges; a longer run
is then a list of pieces with bounds, of which a later task opens those that its range meets. Range bounds are whole
keys (URL key, timestamp, page), so a URL captured very often is spread over tasks, and so is a payload that very many
pages share.

Archives and runs are written to the shared folder under names that a task attempt never uses twice; only names
that a finished task has returned are read, so lost executors and repeated tasks leave nothing wrong behind.

Cases: a null html is an empty payload, a null url an empty URL key; very long payloads are records of their size;
rows that agree in page_id and payload are the same capture, so that both are responses if one is; a null page_id never
is the smallest, and has no history position of its own order but sorts first; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir, joined, table, utf8

MIN_BYTES, ARCHIVE_BYTES, RUN_ROWS, GROUP_ROWS, FAN_IN = 0, 64 << 20, 50_000, 4_096, 128
#: Duplicate payloads up to this many are broadcast (about 50 bytes each); above, Spark joins by shuffling.
FEW = 200_000
RANGE_ROWS, MOST_RANGES, MOST_KEYS = 20_000, 2_000, 20_000
#: Rows of a group of runs that one task merges into a piece of a longer run.
LEVEL_ROWS = 5_000_000
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
ENTRY = [("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query in lower case: com,example)/path?query."""
    try:
        parts = urlsplit((url or "").strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
    except ValueError:
        return f")/{url}".lower()
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path.rstrip('/') or '/'}{query}".lower()


def stamp(page_id: int | None) -> str:
    """The capture time that stands for a page: one second a page from a fixed start."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    url = re.sub(r"[\r\n]", "", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {stamp(page_id)}",
        f"WARC-Payload-Digest: sha1:{sha1_32(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    body = b"" if revisit else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http)}", "", ""]
    return gzip.compress("\r\n".join(head).encode("utf-8", "replace") + http + b"\r\n\r\n", 1, mtime=0)


def records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of each record of an archive, read piece by piece."""
    at, rest = 0, b""
    while True:
        z, out, start = zlib.decompressobj(31), [], at
        while not z.eof:
            data = rest or stream.read(1 << 20)
            rest = b""
            if not data:
                break
            out.append(z.decompress(data))
            at += len(data) - len(z.unused_data)
        if not z.eof:
            if any(out):
                raise ValueError("archive ends inside a record")
            return
        rest = z.unused_data
        head, _, body = b"".join(out).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
        yield start, fields, body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


class LoserTree:
    """k-way merge of sorted iterators; each step replays one leaf-to-root path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads: list[tuple | None] = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if building and other < 0:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _sort_key(e: tuple) -> tuple:
    """Nulls first, without comparing None with numbers."""
    return (e[0], e[1], -(1 << 63) if e[2] is None else e[2], *e[3:])


def _write_run(folder: str, entries: Iterator[tuple] | list[tuple]) -> str | None:
    """Writes sorted entries as a run, a row group at a time; its path."""
    fs, path = filesystem(f"{folder}/run-{uuid.uuid4().hex}.parquet")
    schema, out, part = pa.schema(ENTRY), None, []

    def flush() -> None:
        cols = zip(*part)
        out.write_table(pa.table([pa.array(c, t) for c, (_, t) in zip(cols, ENTRY)], schema=schema))
        part.clear()

    for e in entries:
        if out is None:
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            sink = fs.open_output_stream(path, compression=None)
            out = pq.ParquetWriter(sink, schema, compression="zstd")
        part.append((*e[:2], None if e[2] == -(1 << 63) else e[2], *e[3:]))
        if len(part) >= GROUP_ROWS:
            flush()
    if out is None:
        return None
    if part:
        flush()
    out.close()
    sink.close()
    return f"{folder}/{path.rsplit('/', 1)[1]}"


def _read_run(uri: str, lo: tuple | None, hi: tuple | None) -> Iterator[tuple]:
    """Entries of a run in [lo, hi), of the row groups that overlap it."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and (lo and stats.max < lo[0] or hi and stats.min > hi[0]):
                continue
            for row in zip(*(c.to_pylist() for c in file.read_row_group(g).columns)):
                e = _sort_key(row)
                if (lo is None or e[:3] >= lo) and (hi is None or e[:3] < hi):
                    yield e


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages; one row (archive, run) for each closed archive and for each index run, the other null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha1"))
    same = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = cut(same.withColumnRenamed("sha1", "of"))
    if same.count() <= FEW:
        rows = rows.join(F.broadcast(same), F.col("sha1") == F.col("of"), "left")
    else:
        rows = joined(rows, "sha1", "page_id", same, "of", "left")
    rows = rows.withColumn("repeated", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        sink, name, size, entries = None, "", 0, []

        def done(archive: str | None, index: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.string()), pa.array([index], pa.string())], names=["archive", "run"])

        for b in batches:
            for p, u, h, first, again in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "repeated"))):
                if sink is None:
                    name, size = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    path = filesystem(name)[1]
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                data = record(p, u, utf8(h), again, first)
                sink.write(data)
                entries.append(_sort_key((url_key(u), stamp(p), p, name, size, len(data))))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
                    yield done(name, None)
                if len(entries) >= RUN_ROWS:
                    yield done(None, _write_run(folder, sorted(entries)))
                    entries = []
        if sink is not None:
            sink.close()
            yield done(name, None)
        if entries:
            yield done(None, _write_run(folder, sorted(entries)))

    return cut(rows.select("page_id", "url", "html", "first", "repeated").mapInArrow(run, "archive string, run string"))


def read_archives(spark, archives: DataFrame) -> DataFrame:
    """archive, offset, page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    Bytes and digest are those of the payload read back, which must have the digest that the record states; a revisit
    has no payload, its own are those that it states of the response it refers to.
    """
    schema = "archive string, offset bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = filesystem(name)
                out: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as f:
                    for at, h, payload in records(f):
                        number = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None  # noqa: B023, E731
                        stated, again = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
                        if not again and sha1_32(payload) != stated:
                            raise ValueError(f"the payload at {at} of {name} has not the digest of its record")
                        size = number("X-Payload-Length") if again else len(payload)
                        out.append((name, at, number("X-Page-ID"), size, stated, h["WARC-Type"], number("X-Refers-To-Page")))
                        if len(out) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = archives.where("archive IS NOT NULL").select("archive")
    return names.repartition(max(1, min(2_000, names.count()))).mapInArrow(run, schema)


Piece = tuple[str, tuple | None, tuple | None]


def _meets(piece: Piece, lo: tuple | None, hi: tuple | None) -> bool:
    return not (lo and piece[2] and piece[2] <= lo or hi and piece[1] and piece[1] >= hi)


def _bounds(keys: list[tuple], n: int) -> list[tuple[tuple | None, tuple | None]]:
    """At most n ranges of keys that hold about as many of the sampled, sorted keys each."""
    at = sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []
    return list(zip([None, *at], [*at, None]))


def _piecewise(pieces: list[Piece], lo: tuple | None, hi: tuple | None) -> Iterator[tuple]:
    """Entries in [lo, hi) of a run that is a list of pieces in order."""
    for uri, *_ in pieces:
        yield from _read_run(uri, lo, hi)


def merge_runs(spark, runs: list[str], folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """The captures of all runs in the order of URL key, timestamp and page, with their global `position`."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                fs, path = filesystem(r)
                with fs.open_input_file(path) as f:
                    file = pq.ParquetFile(f)
                    step = max(1, file.metadata.num_rows // (MOST_KEYS // len(runs) + 1))
                    at = 0
                    for g in range(file.num_row_groups):
                        keys = file.read_row_group(g, columns=["urlkey", "timestamp", "page_id"]).combine_chunks()
                        yield from keys.take(pa.array(range(-at % step, keys.num_rows, step), pa.int64())).to_batches()
                        at += keys.num_rows

    schema = "part int, urlkey string, timestamp string, page_id bigint, archive string, offset bigint, length bigint, nth bigint"
    if not runs:
        return spark.createDataFrame([], schema).select("urlkey", "timestamp", "page_id", "archive", "offset", "length", F.col("nth").alias("position"))
    listed = spark.createDataFrame([(r,) for r in runs], "run string").repartition(min(MOST_RANGES, len(runs)))
    keys = sorted(_sort_key((r.urlkey, r.timestamp, r.page_id)) for r in listed.mapInArrow(heads, "urlkey string, timestamp string, page_id bigint").collect())
    rows = spark.read.parquet(*runs).count()
    level: list[list[Piece]] = [[(r, None, None)] for r in sorted(runs)]
    while len(level) > fan_in:
        groups = [level[i : i + fan_in] for i in range(0, len(level), fan_in)]
        cuts = _bounds(keys, max(1, rows // len(groups) // LEVEL_ROWS))
        jobs = [(g, lo, hi, [[p for p in run if _meets(p, lo, hi)] for run in group]) for g, group in enumerate(groups) for lo, hi in cuts]
        shipped = spark.sparkContext.broadcast(jobs)

        def longer(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    _, lo, hi, parts = shipped.value[k]
                    made = _write_run(folder, LoserTree([_piecewise(p, lo, hi) for p in parts]))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([made], pa.string())], names=["job", "run"])

        done = spark.createDataFrame([(k,) for k in range(len(jobs))], "job int").repartitionById(len(jobs), F.col("job")).mapInArrow(longer, "job int, run string").collect()
        level = [[] for _ in groups]
        for k, made in sorted(done):
            if made:
                level[jobs[k][0]].append((made, jobs[k][1], jobs[k][2]))
    ranges = [(k, lo, hi) for k, (lo, hi) in enumerate(_bounds(keys, max(1, min(MOST_RANGES, rows // RANGE_ROWS, len(keys)))))]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), *(t for _, t in ENTRY), pa.int64()]
        names = ["part", *(c for c, _ in ENTRY), "nth"]
        for b in batches:
            for part in b.column(0).to_pylist():
                _, lo, hi = ranges[part]
                out: list[tuple] = []
                for nth, e in enumerate(LoserTree([_piecewise([p for p in run if _meets(p, lo, hi)], lo, hi) for run in level])):
                    out.append((part, *e[:2], None if e[2] == -(1 << 63) else e[2], *e[3:], nth))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    merged = cut(spark.createDataFrame([(k,) for k, *_ in ranges], "part int").repartitionById(len(ranges), F.col("part")).mapInArrow(merge, schema))
    total, starts = 0, []
    for r in sorted(merged.groupBy("part").count().collect()):
        starts.append((r.part, total))
        total += r["count"]
    before = spark.createDataFrame(starts, "part int, before bigint")
    return merged.join(F.broadcast(before), "part").select("urlkey", "timestamp", "page_id", "archive", "offset", "length", (F.col("nth") + F.col("before")).alias("position"))


def captures(spark, pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes, reads back and merges: one row for each page."""
    folder = fresh_dir(spark, "warc")
    written = write_archives(pages, folder, min_bytes)
    found = cut(read_archives(spark, written))
    history = merge_runs(spark, [r.run for r in written.where("run IS NOT NULL").select("run").collect()], folder)
    return found.join(history.select("archive", "offset", "urlkey", "timestamp", "position"), ["archive", "offset"])


def op2_warc_merge(spark, sf_dir: str) -> DataFrame:
    found = captures(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "position")
