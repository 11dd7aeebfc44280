import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stallwright.llm import packing as P
from stallwright.llm.tokenizer import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_bins(counts, capacity):
    """Every piece is placed once, bins are gapless and within capacity."""
    seen = defaultdict(set)
    for b in P.plan(counts, capacity):
        at = 0
        for length, k, rank, offset in b.slots:
            assert offset == at
            at += k * length
            ranks = set(range(rank, rank + k * b.count))
            assert not ranks & seen[length]
            seen[length] |= ranks
        assert 0 < at <= capacity
    assert {k: len(v) for k, v in seen.items()} == {k: v for k, v in counts.items() if v}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40)))
def test_plan(counts):
    check_bins(counts, 60)


def test_plan_is_dense():
    r = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(2048, r.lognormal(6, 1, 20_000).astype(int) + 1), return_counts=True))}
    bins = sum(b.count for b in P.plan(counts))
    assert bins <= 1.003 * sum(k * v for k, v in counts.items()) / 2048 + 1
    large = sum(v for k, v in counts.items() if k * 3 > 2048)
    assert bins >= large / 2


def test_packed(spark):
    texts = {1: prose(1, 3000), 2: None, 3: "", 4: prose(4, 700), 5: prose(4, 700), 6: "a <|endoftext|> b", 7: "日本語 text ﬁ", 8: prose(8, 900)}
    df = docs(spark, texts, {"length": 3, "task": "x"})
    rows = P.packed(df.unionByName(df.where("doc_id = 4")), PATH).collect()
    whole = Tokenizer.from_file(PATH)
    for d, t in texts.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)[:: 2 if d == 4 else 1]
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 2048 for r in mine[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= 2048
    assert P.packed(df.limit(0), PATH).count() == 0


def test_fast_ids_equal_the_tokenizers():
    whole, fast = Tokenizer.from_file(PATH), encoder(PATH)
    every = "".join(chr(c) for c in range(0x250) if not 0xD800 <= c <= 0xDFFF)
    for t in [every, *(every[k : k + 7] + " it's 12ab  \n\n x" for k in range(0, 0x250, 5)), "é" * 50, " " * 40, "naïve <|endoftext|>", "x" * 5000]:
        assert fast(t).tolist() == whole.encode(t, add_special_tokens=False).ids
