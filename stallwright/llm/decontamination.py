"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A benchmark item gives every
window of `window` consecutive words, or itself if it is shorter. The automaton reads words, not characters: each
word of the benchmark is a code of two characters from two alphabets, so a match always covers whole words, and a
window of ten words is twenty nodes at most. A document is normalised and scanned once, and the words found are mapped
back to character spans of the original text. A Python worker builds the automaton once for all its tasks.

The benchmark is broadcast only up to `max_chars` characters, for which the automaton has some 3 million nodes of 40
bytes; a larger one is cut into chunks of at most that size by a hash of the item. Every chunk then is a pass of its
own over the documents, one after the other, which returns the texts it hits; these are joined by digest.

Cases: null or empty texts have no words and no hits; items without words match nothing; equal windows of several
items count for each; items with a null id are one item, "null"; very long texts are scanned whole; repeated documents
each get their own row; an empty table gives an empty result, an empty benchmark leaves every document clean; kept
columns come through unless they are named like a result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_names, kept_rows, text_digest, tidy, words

WINDOW = 10
MAX_CHARS = 1_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = "spans array<struct<first_word:bigint,end_word:bigint,start:bigint,end:bigint>>"


class Codes(dict):
    """Two characters for each word of the benchmark, blanks for all others; the alphabets of the two don't meet."""

    def __init__(self, vocabulary: list[bytes]):
        size, first = max(1, math.isqrt(len(vocabulary)) + 1), 0x100
        if first + 2 * size >= 0xD800:
            raise ValueError("the vocabulary of a chunk is too large")
        super().__init__((w, chr(first + k // size) + chr(first + size + k % size)) for k, w in enumerate(vocabulary))

    def __missing__(self, word: bytes) -> str:
        return "  "

    def of(self, w: list[bytes]) -> str:
        return "".join(map(self.__getitem__, w))


class Matcher:
    """The automaton of items (id, text). Values: (words in the window, ids of the items that have it)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = [(item, words(text)) for item, text in items]
        self.codes = Codes(sorted({x for _, w in texts for x in w}))
        owners: dict[str, set[str]] = {}
        for item, w in texts:
            flat, n = self.codes.of(w), min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                owners.setdefault(flat[2 * i : 2 * (i + n)], set()).add(item)
        self.found = ahocorasick.Automaton() if owners else None
        if self.found is not None:
            for flat, ids in owners.items():
                self.found.add_word(flat, (len(flat) // 2, tuple(sorted(ids))))
            self.found.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words in the text, merged [first, end) ranges of hit words, items found."""
        w, hits, items = words(text), [], set()
        for last, (n, ids) in self.found.iter(self.codes.of(w)) if w and self.found is not None else ():
            hits.append((last // 2 + 1 - n, last // 2 + 1))
            items.update(ids)
        return len(w), merged(hits), items


_built: dict[str, Matcher] = {}


def matcher(name: str, shipped, window: int) -> Matcher:
    """The matcher of a broadcast chunk; a worker keeps the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(shipped.value, window)
    return _built[name]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def located(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """The ranges of words with their character offsets in the original text."""
    places = [m.span() for m in WORD.finditer(text)] if ranges else []
    return [{"first_word": a, "end_word": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


def item_chunks(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's (id, text) rows, in one list if they have at most half of `max_chars` characters."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"),
        F.col(f"`{item_text}`").cast("string").alias("item_text"),
    )
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    chunks = max(1, math.ceil(2 * size / max_chars))
    for chunk in range(chunks):
        part = items if chunks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == chunk)
        yield [(r.item, r.item_text) for r in part.toLocalIterator()]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """The documents without any benchmark passage, with all their columns."""
    chunks = list(_shipped(docs, item_chunks(benchmark, max_chars=max_chars)))
    if len(chunks) == 1:
        name, shipped = chunks[0]

        def make():
            found = matcher(name, shipped, window)
            return lambda text: not found.scan(text)[1]

        return kept_rows(docs, make)
    names = fresh_names(docs, 1)
    rows = docs.withColumn(names[0], text_digest("text"))
    hit = _hits(docs, "text", chunks, window).select(F.col("digest").alias(names[0]))
    return rows.join(hit, names[0], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _shipped(docs: DataFrame, chunks: Iterator[list]) -> Iterator[tuple[str, object]]:
    for rows in chunks:
        yield uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(rows)


RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _hits(docs: DataFrame, text: str, chunks: list, window: int) -> DataFrame:
    """digest, ranges and items of the texts that any chunk hits; every chunk is a scan of its own."""
    rows, parts = docs.select(text_digest(text).alias("digest"), F.col(f"`{text}`").cast("string").alias("text")), []
    for name, shipped in chunks:

        @tidy
        def run(batches: Iterator[pa.RecordBatch], name=name, shipped=shipped) -> Iterator[pa.RecordBatch]:
            found = matcher(name, shipped, window)
            for b in batches:
                hits = [(d.as_py(), *found.scan(t.as_py())[1:]) for d, t in zip(b.column(0), b.column(1))]
                hits = [h for h in hits if h[1]]
                ranges = [[{"a": x, "b": y} for x, y in r] for _, r, _ in hits]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.binary()), pa.array(ranges, RANGES), pa.array([sorted(h[2]) for h in hits], pa.list_(pa.string()))], names=["digest", "ranges", "items"])

        found = rows.mapInArrow(run, "digest binary, ranges array<struct<a:bigint,b:bigint>>, items array<string>")
        parts.append(cut(found.dropDuplicates(["digest"])))
    every = functools.reduce(DataFrame.union, parts)
    return every.groupBy("digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """Columns `keep` of every document plus n_words, n_hit, items (sorted ids) and spans of the hit passages."""
    chunks = list(_shipped(docs, item_chunks(benchmark, item_id, item_text, max_chars)))
    results = T._parse_datatype_string(f"n_words bigint, n_hit bigint, items array<string>, {SPANS}").fields
    keep = tuple(k for k in keep if k not in {f.name for f in results})
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([(x, pa.int64()) for x in ("first_word", "end_word", "start", "end")]))]
    kept = docs.select(*(F.col(f"`{k}`").alias(f"c{n}") for n, k in enumerate(keep)), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField(k, f.dataType, f.nullable) for k, f in zip(keep, kept.schema.fields)] + results)
    many = len(chunks) > 1
    if many:
        kept = kept.withColumn("digest", text_digest()).join(_hits(docs, text, chunks, window), "digest", "left").drop("digest")
    name, shipped = chunks[0]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None if many else matcher(name, shipped, window).scan
        for b in batches:
            out: list[tuple] = []
            old = zip(b.column("ranges").to_pylist(), b.column("items").to_pylist()) if many else itertools.repeat(None)
            for t, o in zip(b.column("text"), old):
                t = t.as_py()
                n, ranges, items = scan(t) if scan else (len(words(t)), merged([(x["a"], x["b"]) for x in o[0] or []]), o[1] or [])
                out.append((n, sum(y - x for x, y in ranges), sorted(items), located(t, ranges) if ranges else []))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=schema.names)

    return kept.mapInArrow(run, schema)


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """Every window of every item tried at every word; for tests."""
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(item)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS win, least(len(w), {WINDOW}) AS n
       FROM (SELECT item, w, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, bw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
