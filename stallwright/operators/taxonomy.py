"""Variant axes from titles: n-grams, match sets, mutual exclusivity, communities, post-processing, assignment.

Work that grows with the listings (n-grams, match sets, pair counts, assignment) is DataFrames. What is left per job
are the significant n-grams and their pair counts, a few hundred values whatever the number of listings; these go
through small matrix functions, one group of rows for each job.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngram_tokens, ngrams, resolved_substring, tokens
from ..store import saved

#: Words that are no variant values (fixed values).
GENERIC = ("with", "free", "all", "day", "next", "del", "count", "brand")


@dataclass(frozen=True)
class TaxonomyOptions:
    """Thresholds of the taxonomy (fixed values); the floors can be lowered for small samples."""

    min_unigram: int = 20
    min_ngram: int = 10
    divisor: int = 200
    significance: float = 0.03
    min_exclusive: int = 3
    exclusivity: float = 0.05
    edge_similarity: float = 0.15
    dedupe_overlap: float = 0.85
    dedupe_cosine: float = 0.90
    merge_jaccard: float = 0.70
    merge_containment: float = 0.85
    merge_cosine: float = 0.75
    resolution: float = 2.0
    prune_large: float = 0.35
    prune_small: float = 0.20
    large_axis: int = 5
    outlier_cosine: float = 0.30
    synonym_cosine: float = 0.80
    title_cosine: float = 0.60


DEFAULTS = TaxonomyOptions()


def distinct_titles(titles: DataFrame) -> DataFrame:
    """One row for each title of a job, with the number of listings that have it as `weight`.

    Many listings share a title; n-grams and pairs are worked out once for each.
    """
    more = [c for c in ("search_term",) if c in titles.columns]
    return titles.groupBy("job_id", "title", *more).agg(F.count("*").alias("weight"), F.min("listing_id").alias("listing_id"))


def decontaminated(titles: DataFrame, brands: tuple[str, ...], o: TaxonomyOptions = DEFAULTS) -> DataFrame:
    """Titles with at least one of the tokens whose embedding is near that of their search term; ids stay as they were."""

    @F.pandas_udf("double")
    def cosine(title: pd.Series, term: pd.Series) -> pd.Series:
        known = {t: embed(t.lower()) for t in {*title, *term}}
        return pd.Series([float(known[a] @ known[b]) for a, b in zip(title, term)])

    some = titles.where(F.arrays_overlap(tokens(F.col("title")), F.array(*(F.lit(b) for b in brands))))
    return some.where(cosine("title", "search_term") >= o.title_cosine)


def extract_ngrams(titles: DataFrame, o: TaxonomyOptions = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Kept n-grams (job_id, g, df) and their matches (job_id, g, listing_id, weight) of distinct titles.

    With a column search_term, its words count as none: the words beside them are neighbours.
    """
    words = ngram_tokens(F.col("title"))
    if "search_term" in titles.columns:
        words = F.filter(words, lambda w: ~F.array_contains(ngram_tokens(F.col("search_term")), w))
    rows = titles.select("job_id", "listing_id", "weight", F.explode(F.array_distinct(ngrams(words))).alias("g"))
    n = titles.groupBy("job_id").agg(F.sum("weight").alias("n"))
    floor = F.greatest(F.when(F.contains(F.col("g"), F.lit(" ")), o.min_ngram).otherwise(o.min_unigram), F.expr(f"n div {o.divisor}"))
    kept = rows.groupBy("job_id", "g").agg(F.sum("weight").alias("df")).join(F.broadcast(n), "job_id").where(F.col("df") >= floor)
    return kept, rows.join(kept.select("job_id", "g"), ["job_id", "g"])


def longest_matches(kept: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches without those of an n-gram whose words are a proper part of a longer one that the title has too."""
    words = kept.select("job_id", "g", F.array_sort(F.array_distinct(F.split("g", " "))).alias("w"))
    a, b = words.select("job_id", F.col("g").alias("short"), F.col("w").alias("ws")), words.select("job_id", F.col("g").alias("g"), F.col("w").alias("wl"))
    covers = b.withColumn("x", F.explode("wl")).join(a.withColumn("x", F.element_at("ws", 1)), ["job_id", "x"])
    covers = covers.where((F.size(F.array_except("ws", "wl")) == 0) & (F.size("ws") < F.size("wl"))).select("job_id", "g", "short")
    beaten = matches.join(covers, ["job_id", "g"]).select("job_id", "listing_id", F.col("short").alias("g"))
    return matches.join(beaten, ["job_id", "listing_id", "g"], "left_anti")


def pair_counts(matches: DataFrame) -> DataFrame:
    """(job_id, a, b, common): listings that two n-grams share, for pairs that share any."""
    x, y = matches.withColumnRenamed("g", "a"), matches.withColumnRenamed("g", "b").drop("weight")
    return x.join(y, ["job_id", "listing_id"]).where("a < b").groupBy("job_id", "a", "b").agg(F.sum("weight").alias("common"))


def significant(matches: DataFrame, titles: DataFrame, o: TaxonomyOptions = DEFAULTS) -> DataFrame:
    """(job_id, g, size) of match sets with at least int(significance * n) listings."""
    n = titles.groupBy("job_id").agg(F.sum("weight").alias("n"))
    sizes = matches.groupBy("job_id", "g").agg(F.sum("weight").alias("size")).join(F.broadcast(n), "job_id")
    return sizes.where(F.col("size") >= F.greatest(F.lit(1), F.floor(F.col("n") * o.significance))).drop("n")


def exclusive_pairs(sets: DataFrame, pairs: DataFrame, o: TaxonomyOptions = DEFAULTS) -> DataFrame:
    """(job_id, a, b) whose overlap coefficient is below the limit; pairs without a common listing included.

    The pairs are of significant sets of one job, at most 1 / significance times the sets of a title.
    """
    a, b = sets.select("job_id", F.col("g").alias("a"), F.col("size").alias("na")), sets.select("job_id", F.col("g").alias("b"), F.col("size").alias("nb"))
    both = a.join(b, "job_id").where("a < b").join(pairs, ["job_id", "a", "b"], "left")
    return both.where(F.coalesce("common", F.lit(0)) / F.least("na", "nb") < o.exclusivity).select("job_id", "a", "b")


# ---- small functions on the values of one job


def embed(text: str, size: int = 64) -> np.ndarray:
    """A deterministic stand-in for a text embedding: hashed character trigrams, of unit length."""
    v = np.zeros(size)
    padded = f"^{text}$"
    for k in range(max(1, len(padded) - 2)):
        h = zlib.crc32(padded[k : k + 3].encode())
        v[h % size] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def louvain(n: int, edges: list[tuple[int, int, float]], resolution: float = 2.0) -> list[int]:
    """Community of each node by local moving in node order until nothing strictly gains; no aggregation phase."""
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] += x
        w[b, a] += x
    degree, label = w.sum(1), np.arange(n)
    m = degree.sum() / 2
    if not m:
        return label.tolist()
    moved = True
    while moved:
        moved = False
        for node in range(n):
            near = np.unique(label[w[node] > 0])
            if not len(near):
                continue
            own = label[node]
            gain = {}
            for c in {*near.tolist(), int(own)}:
                inside = label == c
                inside[node] = False
                gain[c] = w[node, inside].sum() / m - resolution * degree[node] * degree[inside].sum() / (2 * m * m)
            best = max((c for c in gain if c != own), key=lambda c: (gain[c], -c), default=own)
            if best != own and gain[best] - gain[own] > 1e-12:
                label[node], moved = best, True
    first: dict[int, int] = {}
    return [first.setdefault(int(c), len(first)) for c in label]


def union_find(n: int, links: Iterable[tuple[int, int]]) -> list[int]:
    """Component of each node, numbered by first appearance."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    first: dict[int, int] = {}
    return [first.setdefault(top(x), len(first)) for x in range(n)]


Group = tuple[str, int, list[str]]


def synonym_groups(grams: list[str], freq: list[int], threshold: float = 0.80, embedding: Callable[[str], np.ndarray] = embed) -> list[Group]:
    """Components of similar n-grams that are no numeric variants: the most frequent form, summed frequency, all forms.

    Cosines are compared in blocks of rows, with some room for rounding: a cosine of just the threshold is similar.
    """
    import re

    e = np.array([embedding(g) for g in grams])
    form = [(re.sub(r"\d+", "#", g), re.findall(r"\d+", g)) for g in grams]

    def links():
        for at in range(0, len(grams), 128):
            for i, j in np.argwhere(np.triu(e[at : at + 128] @ e.T >= threshold - 1e-9, at + 1)).tolist():
                i += at
                if not (form[i][0] == form[j][0] and "#" in form[i][0] and form[i][1] != form[j][1]):
                    yield i, j

    comp: dict[int, list[int]] = {}
    for k, c in enumerate(union_find(len(grams), links())):
        comp.setdefault(c, []).append(k)
    return [(grams[min(ks, key=lambda k: (-freq[k], grams[k]))], sum(freq[k] for k in ks), [grams[k] for k in ks]) for ks in comp.values()]


def merge_synonyms(grams: list[str], freq: list[int], threshold: float = 0.80) -> list[tuple[str, int]]:
    return [(g, f) for g, f, _ in synonym_groups(grams, freq, threshold)]


def subsumed(groups: list[Group], threshold: float = 0.80) -> list[Group]:
    """Fewer words (at least two) absorb longer n-grams that contain them and are similar, greedily in order."""
    out: list[Group] = []
    short: list[tuple[int, set[str]]] = []  # place in out and words of those that can absorb
    for g, f, forms in sorted(groups, key=lambda x: (len(x[0].split()), -x[1], x[0])):
        words = set(g.split())
        for k, part in short if len(words) > 2 else ():
            if len(part) < len(words) and part <= words and embed(out[k][0]) @ embed(g) >= threshold:
                out[k] = (out[k][0], out[k][1] + f, out[k][2] + forms)
                break
        else:
            if len(words) >= 2:
                short.append((len(out), words))
            out.append((g, f, list(forms)))
    return out


def subsume(grams: list[tuple[str, int]], threshold: float = 0.80) -> list[tuple[str, int]]:
    return [(g, f) for g, f, _ in subsumed([(g, f, [g]) for g, f in grams], threshold)]


def synonyms(kept: DataFrame, o: TaxonomyOptions = DEFAULTS, embedding: Callable[[str], np.ndarray] = embed) -> DataFrame:
    """(job_id, canonical, frequency, forms): the kept n-grams of each job with synonyms merged, forms by falling frequency."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["df", "g"], ascending=[False, True])
        groups = synonym_groups(pdf.g.tolist(), pdf["df"].astype(int).tolist(), o.synonym_cosine, embedding)
        return pd.DataFrame([(key[0], *group) for group in groups], columns=["job_id", "canonical", "frequency", "forms"])

    return kept.select("job_id", "g", "df").groupBy("job_id").applyInPandas(one, "job_id bigint, canonical string, frequency bigint, forms array<string>")


def canonical(kept: DataFrame, o: TaxonomyOptions = DEFAULTS) -> DataFrame:
    """(job_id, form, g): the n-gram that stands for each kept one after merging synonyms and absorbing longer ones.

    The kept n-grams of a job pass its frequency floors, so they are some hundreds whatever its listings.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        groups = subsumed(synonym_groups(pdf.g.tolist(), pdf["df"].astype(int).tolist(), o.synonym_cosine), o.synonym_cosine)
        return pd.DataFrame([(key[0], form, g) for g, _, forms in groups for form in forms], columns=["job_id", "form", "g"])

    return kept.select("job_id", "g", "df").groupBy("job_id").applyInPandas(one, "job_id bigint, form string, g string")


class Overlaps:
    """Set sizes and common counts of the values of one job."""

    def __init__(self, sizes: dict[str, int], common: dict[tuple[str, str], int]):
        self.sizes, self.pairs = sizes, common

    def common(self, a: str, b: str) -> int:
        return self.sizes.get(a, 0) if a == b else self.pairs.get((min(a, b), max(a, b)), 0)

    def overlap(self, a: str, b: str) -> float:
        least = min(self.sizes.get(a, 0), self.sizes.get(b, 0))
        return self.common(a, b) / least if least else 0.0

    def jaccard(self, a: str, b: str) -> float:
        whole = self.sizes.get(a, 0) + self.sizes.get(b, 0) - self.common(a, b)
        return self.common(a, b) / whole if whole else 1.0

    def matrix(self, values: list[str]) -> np.ndarray:
        m = np.array([[self.overlap(a, b) for b in values] for a in values]).reshape(len(values), len(values))
        np.fill_diagonal(m, 0)
        return m


Axes = list[list[str]]


def drop_generic(axes: Axes) -> Axes:
    return [a for a in ([v for v in axis if v not in GENERIC] for axis in axes) if len(a) >= 2]


def dedupe_overlap(axes: Axes, s: Overlaps, limit: float = DEFAULTS.dedupe_overlap) -> Axes:
    """Of two values with much overlap the smaller set goes, of equal ones the later."""
    out = []
    for axis in axes:
        keep: list[str] = []
        for v in sorted(axis, key=lambda v: (-s.sizes.get(v, 0), axis.index(v))):
            if all(s.overlap(v, k) < limit for k in keep):
                keep.append(v)
        out.append([v for v in axis if v in keep])
    return [a for a in out if len(a) >= 2]


def same_stem(a: str, b: str) -> bool:
    short, long = sorted((a.lower(), b.lower()), key=len)
    if len(short) < 3:
        return False
    return long.startswith(short) and long[len(short) :] in ("ed", "d", "ing", "er", "est", "ic", "s") or len(a) == len(b) and sum(x != y for x, y in zip(short, long)) == 1


def dedupe_embed(axes: Axes, limit: float = DEFAULTS.dedupe_cosine) -> Axes:
    """Stem variants and near-equal embeddings keep their shorter label, never below two values."""
    out = []
    for axis in axes:
        left = list(axis)
        for i, a in enumerate(axis):
            for b in axis[i + 1 :]:
                if a in left and b in left and len(left) > 2 and (same_stem(a, b) or embed(a) @ embed(b) >= limit):
                    left.remove(max(a, b, key=len))
        out.append(left)
    return out


def prune_overlap(axes: Axes, s: Overlaps, o: TaxonomyOptions = DEFAULTS) -> Axes:
    """Removes, one by one, the value with most overlapping partners; ties lose the smaller set."""
    out = []
    for axis in axes:
        left = list(axis)
        while len(left) >= 2:
            limit = o.prune_large if len(left) >= o.large_axis else o.prune_small
            partners = (s.matrix(left) > limit).sum(1)
            if not partners.max():
                break
            left.remove(min(left, key=lambda v: (-partners[left.index(v)], s.sizes.get(v, 0), left.index(v))))
        out.append(left)
    return [a for a in out if len(a) >= 2]


def enforce_exclusive(axes: Axes, s: Overlaps, limit: float = DEFAULTS.exclusivity) -> Axes:
    """Removes, one by one, the first value with most violations of exclusivity."""
    out = []
    for axis in axes:
        left = list(axis)
        while len(left) >= 2 and (bad := (s.matrix(left) >= limit).sum(1)).max():
            left.pop(int(bad.argmax()))
        out.append(left)
    return [a for a in out if len(a) >= 2]


def drop_outliers(axes: Axes, limit: float = DEFAULTS.outlier_cosine) -> Axes:
    """Values whose mean cosine to the others is low go; an axis left with fewer than two goes whole."""
    out = []
    for axis in axes:
        if len(axis) < 2:
            continue
        e = np.array([embed(v) for v in axis])
        mean = ((e @ e.T).sum(1) - 1) / max(1, len(axis) - 1)
        out.append([v for v, c in zip(axis, mean) if c >= limit])
    return [a for a in out if len(a) >= 2]


def unify(axes: Axes, s: Overlaps, o: TaxonomyOptions = DEFAULTS) -> Axes:
    """Drops values that contain an earlier axis's words, then merges axes alike in sets, containment or meaning.

    Of merged axes, the one of fewest mean words stays, of these the largest.
    """
    cleaned: Axes = []
    for axis in axes:
        earlier = [set(v.split()) for done in cleaned for v in done]
        kept = [v for v in axis if not any(e < set(v.split()) for e in earlier)]
        if len(kept) >= 2:
            cleaned.append(kept)

    def alike(a: list[str], b: list[str]) -> bool:
        if np.mean([max(s.jaccard(x, y) for y in b) for x in a]) >= o.merge_jaccard:
            return True
        best = [max(b, key=lambda y: s.overlap(x, y)) for x in a]
        if len(a) == len(b) == len(set(best)) and all(s.overlap(x, y) >= o.merge_containment for x, y in zip(a, best)):
            return True
        return float(np.mean([max(embed(x) @ embed(y) for y in b) for x in a])) >= o.merge_cosine

    links = [(i, j) for i in range(len(cleaned)) for j in range(i + 1, len(cleaned)) if alike(cleaned[i], cleaned[j])]
    groups: dict[int, Axes] = {}
    for k, c in enumerate(union_find(len(cleaned), links)):
        groups.setdefault(c, []).append(cleaned[k])
    return [min(g, key=lambda a: (np.mean([len(v.split()) for v in a]), -sum(s.sizes.get(v, 0) for v in a))) for g in groups.values()]


def validated(axes: Axes, s: Overlaps, limit: float = DEFAULTS.exclusivity, share: float = 0.30) -> Axes:
    """Axes with more than `share` violating pairs go."""
    return [a for a in axes if np.triu(s.matrix(a) >= limit, 1).sum() <= share * len(a) * (len(a) - 1) / 2]


def refine(axes: dict[str, list[str]], sizes: dict[str, int], n: int, delta: dict, significance: float = DEFAULTS.significance) -> dict[str, list[str]]:
    """Applies merges, drops, renames, removals (not of significant values) and additions to named axes."""
    out = {k: list(v) for k, v in axes.items()}
    for into, others in delta.get("merge", {}).items():
        for other in others:
            out.setdefault(into, []).extend(v for v in out.pop(other, []) if v not in out.get(into, []))
    for name in delta.get("drop", []):
        out.pop(name, None)
    for old, new in delta.get("rename", {}).items():
        if old in out:
            out[new] = out.pop(old)
    for name, values in delta.get("remove", {}).items():
        out[name] = [v for v in out.get(name, []) if v not in values or sizes.get(v, 0) >= significance * n]
    for name, values in delta.get("add", {}).items():
        out.setdefault(name, []).extend(v for v in values if v not in out.get(name, []))
    return {k: v for k, v in out.items() if v}


def build_axes(values: pd.DataFrame, pairs: pd.DataFrame, o: TaxonomyOptions = DEFAULTS) -> Axes:
    """Axes of one job from its significant n-grams (g, size) and pair counts (a, b, common)."""
    rows = values.sort_values(["size", "g"], ascending=[False, True])
    grams, sizes = rows.g.tolist(), dict(zip(rows.g, rows["size"].astype(int)))
    known = set(grams)
    s = Overlaps(sizes, {(a, b): int(c) for a, b, c in zip(pairs.a, pairs.b, pairs.common) if a in known and b in known})
    exclusive = s.matrix(grams) < o.exclusivity
    np.fill_diagonal(exclusive, False)
    chosen = [k for k in range(len(grams)) if exclusive[k].sum() >= o.min_exclusive]
    if len(chosen) < 2:
        return []
    e = np.array([embed(grams[k]) for k in chosen])
    near = e @ e.T
    edges = [(i, j, float(near[i, j])) for i in range(len(chosen)) for j in range(i + 1, len(chosen)) if exclusive[chosen[i], chosen[j]] and near[i, j] > o.edge_similarity]
    if not edges:
        return []
    groups: dict[int, list[str]] = {}
    for k, c in enumerate(louvain(len(chosen), edges, o.resolution)):
        groups.setdefault(c, []).append(grams[chosen[k]])
    axes = [g for g in groups.values() if len(g) >= 2]
    axes = dedupe_embed(dedupe_overlap(axes, s, o.dedupe_overlap), o.dedupe_cosine)
    axes = enforce_exclusive(prune_overlap(axes, s, o), s, o.exclusivity)
    return unify(drop_outliers(drop_generic(axes), o.outlier_cosine), s, o)


def by_job(sets: DataFrame, pairs: DataFrame):
    """The two frames of each job with sets together, pairs of its sets only; fresh columns, as both may come from one frame."""
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))
    small = pairs.join(sets.select("job_id", F.col("g").alias("a")), ["job_id", "a"], "left_semi").join(sets.select("job_id", F.col("g").alias("b")), ["job_id", "b"], "left_semi")
    return fresh(sets).groupBy("job_id").cogroup(fresh(small).groupBy("job_id"))


def axes_of_jobs(sets: DataFrame, pairs: DataFrame, o: TaxonomyOptions = DEFAULTS) -> DataFrame:
    """(job_id, axis, label, size) for every job."""

    def one(key, values: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        sizes = dict(zip(values.g, values["size"]))
        rows = [(key[0], f"Axis {k}", v, int(sizes.get(v, 0))) for k, axis in enumerate(build_axes(values, common, o)) for v in axis]
        return pd.DataFrame(rows, columns=["job_id", "axis", "label", "size"])

    return by_job(sets, pairs).applyInPandas(one, "job_id bigint, axis string, label string, size bigint")


def assign_cells(titles: DataFrame, axes: DataFrame, matches: DataFrame) -> DataFrame:
    """(listing_id, job_id, cell, has_conflict): a value for each axis that a title matches.

    Of several matching values, the one that contains all others; else the first by size and label, as a conflict.
    """
    hits = matches.withColumnRenamed("g", "label").join(F.broadcast(axes), ["job_id", "label"])
    per_axis = hits.groupBy("job_id", "listing_id", "axis").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "label"))).alias("v"))
    labels = F.transform("v", lambda x: x["label"])
    resolved = resolved_substring(labels)
    chosen = per_axis.select("job_id", "listing_id", "axis", F.coalesce(resolved, labels[0]).alias("value"), resolved.isNull().alias("conflict"))
    cells = chosen.groupBy("job_id", "listing_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "value")))).alias("cell"), F.bool_or("conflict").alias("has_conflict"))
    return titles.select("job_id", "listing_id").join(cells, ["job_id", "listing_id"], "left").withColumn("has_conflict", F.coalesce("has_conflict", F.lit(False)))


def run(titles: DataFrame, o: TaxonomyOptions = DEFAULTS, brands: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Axes of all jobs, and the assignment of every title that stays (job_id, listing_id, cell, has_conflict).

    Decontamination (with brand tokens), n-grams without the words of the search term, synonyms, absorbed n-grams,
    match sets, exclusive pairs, communities, post-processing, assignment. A title matches an n-gram if it has any of
    the forms that the n-gram stands for. Distinct titles and matches are written once and read by all that follows.
    """
    titles = decontaminated(titles, brands, o) if brands else titles
    kinds = saved(distinct_titles(titles), "titles")
    kept, matches = extract_ngrams(kinds, o)
    kept = saved(kept, "ngrams")
    forms = F.broadcast(canonical(kept, o))
    matches = matches.withColumnRenamed("g", "form").join(forms, ["job_id", "form"]).groupBy("job_id", "listing_id", "g").agg(F.first("weight").alias("weight"))
    matches = saved(longest_matches(matches.select("job_id", "g").distinct(), matches), "matches")
    sets = significant(matches, kinds, o)
    axes = saved(axes_of_jobs(sets, pair_counts(matches), o), "axes")
    cells = assign_cells(kinds, axes, matches).join(kinds.select("job_id", "listing_id", "title"), ["job_id", "listing_id"]).drop("listing_id")
    return axes, titles.select("job_id", "listing_id", "title").join(cells, ["job_id", "title"]).drop("title")
