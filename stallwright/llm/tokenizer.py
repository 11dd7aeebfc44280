"""Token ids of a public byte-level BPE file, one encoder for each worker process."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np

#: Below U+0250 the two libraries' character classes are the same; other texts, and special tokens, go to `tokenizers`.
PLAIN = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")


@functools.cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids as tokenizers' encode(text, add_special_tokens=False) gives them.

    If the file's ranks lie beside it in tiktoken's format, with equal vocabulary, texts of plain characters are
    encoded with these, which gives the same ids at a third of the CPU time (covered by a test).
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    @functools.cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    slow = lambda text: np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)
    ranks_at = re.sub(r"\.json$", ".tiktoken", path)
    spec = _spec(path)
    if not (path.endswith(".json") and os.path.exists(ranks_at)) or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return slow
    import tiktoken
    from public_tokenizers import PATTERN

    fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=_ranks(ranks_at), special_tokens={}).encode_to_numpy
    return lambda text: slow(text) if PLAIN.search(text) else fast(text)


def _ranks(at: str) -> dict[bytes, int]:
    with open(at, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def id_type(path: str) -> str:
    """The little-endian unsigned type that holds every id of the file: 16 bits where they suffice, else 32."""
    spec = _spec(path)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return "<u2" if most < 1 << 16 else "<u4"


@functools.cache
def token_bytes(path: str) -> dict[bytes, int] | None:
    """Id of every token by its bytes, if the ids of a text spell its bytes out; else None."""
    spec, ranks_at = _spec(path), re.sub(r"\.json$", ".tiktoken", path)
    if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or not os.path.exists(ranks_at):
        return None
    return _ranks(ranks_at) | {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
