"""WARC archives, audio, chats, training order."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import docs, prose
from pyspark.sql import functions as F

from stallwright.llm import audio as A
from stallwright.llm import chat_format as C
from stallwright.llm import common as M
from stallwright.llm import training_order as O
from stallwright.llm import warc_merge as W
from stallwright.llm.common import fresh_dir


def test_loser_tree_merges_any_number_of_runs():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted((r.randint(0, 9), r.random()) for _ in range(r.randint(0, 7))) for _ in range(k)]
        assert list(W.LoserTree([iter(x) for x in runs])) == sorted(x for y in runs for x in y)


def test_captures(spark, monkeypatch):
    monkeypatch.setattr(W, "RUN_ROWS", 7)
    monkeypatch.setattr(W, "RANGE_ROWS", 10)
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 4000)
    rows = [(k, f"http://www.h{k % 3}.example/{k % 4}?b=1&a=2", f"<p>é{k % 5}</p>" * (k % 5)) for k in range(60)] + [(70, None, None), (71, "http://[bad", "x" * 100_000), (None, "u", "<p>é1</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).withColumn("archive", F.lit(1))
    got = W.captures(spark, pages).collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    for r in got:
        h = next((x[2] or "").encode() for x in rows if x[0] == r.page_id)
        own = first[h.decode()] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[h.decode()]))
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(rows)))
    keys = [(r.urlkey, r.timestamp, -1 if r.page_id is None else r.page_id) for r in order]
    assert keys == sorted(keys)
    assert W.captures(spark, pages.limit(0)).count() == 0


def test_runs_beyond_the_fan_in_are_merged_in_levels(spark, monkeypatch):
    folder = fresh_dir(spark, "runs")
    entries = [W._sort_key((f"k{k % 17:02d}", f"t{k:03d}", k, "a", k, 1)) for k in range(100)]
    runs = [W._write_run(folder, sorted(entries[k::9])) for k in range(9)]
    for rows in (W.LEVEL_ROWS, 8):  # groups merged whole, and by ranges
        monkeypatch.setattr(W, "LEVEL_ROWS", rows)
        got = [(r.urlkey, r.page_id) for r in W.merge_runs(spark, runs, folder, fan_in=2).orderBy("position").collect()]
        assert got == [(e[0], e[2]) for e in sorted(entries)]


def test_a_payload_of_very_many_pages_is_split(spark, monkeypatch):
    monkeypatch.setattr(W, "FEW", 0)
    monkeypatch.setattr(M, "TOGETHER", 10)
    pages = spark.createDataFrame([(k, "u", "same" if k % 3 else f"own {k}") for k in range(1, 100)], "page_id bigint, url string, html string")
    pages = pages.unionByName(pages.where("page_id = 5"))  # a repeated row
    got = W.captures(spark, pages).collect()
    assert len(got) == 100
    for r in got:
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("revisit", 1, 4) if r.page_id % 3 and r.page_id != 1 else ("response", None, 4 if r.page_id == 1 else len(f"own {r.page_id}")))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    assert {r.page_id: r.record_type for r in W.captures(spark, pages, min_bytes=3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_audio(spark):
    assert A.from_wav(A.to_wav(b"abc")) == b"abc"
    tone = (np.sin(2 * np.pi * 1000 * np.arange(192 * 40) / 12000) * 100 + 128).astype(np.uint8)
    mel = A.log_mel(tone.tobytes())
    assert mel.shape == (40, A.BANDS) and mel[5].argmax() == mel[30].argmax()
    whole, A_FRAMES = A.log_mel(tone.tobytes()), A.FRAMES
    A.FRAMES = 16
    assert np.allclose(A.log_mel(tone.tobytes()), whole, atol=1e-3)
    A.FRAMES = A_FRAMES
    quiet_loud = np.concatenate([np.full(192 * 20, 128, np.uint8), tone, np.full(192 * 20, 128, np.uint8)])
    assert len(A.segments(A.log_mel(quiet_loud.tobytes()))) == 1
    texts = {1: prose(1, 300), 2: None, 3: "", 4: prose(1, 300), 5: prose(2, 20_000), 6: "é" * 96}
    rows = {r.doc_id: r for r in A.audio_features(docs(spark, texts, {"feature": "f"}), with_media=True).collect()}
    for k, t in texts.items():
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert r.feature == A.feature_of(bytes(r.tensors)) and r.feature.startswith(f"{r.n_segments}:")
        batch = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert batch.num_rows == r.n_segments and batch.schema.field("log_mel").type.shape == list(A.SHAPE)
    assert rows[1].feature == rows[4].feature and rows[2].feature == rows[3].feature
    assert A.audio_features(docs(spark, texts).limit(0)).count() == 0


def test_log_mel_equals_a_direct_computation():
    """Resampling by the filter's sum over all taps, the transform by its definition, bands by their triangles."""
    x = np.random.default_rng(3).integers(0, 256, 192 * 3).astype(np.uint8)
    samples = np.pad(x.astype(np.float32) / 128 - 1, (A.TAPS, 600))
    h = np.sinc((np.arange(A.TAPS * A.UP) - (A.TAPS * A.UP - 1) / 2) / A.DOWN) / A.DOWN * np.hamming(A.TAPS * A.UP) * A.UP
    whole = A.resampled(samples)
    for m in range(400):  # zeros between the samples, the filter over all of it, every DOWN-th value
        want = sum(h[k] * samples[(m * A.DOWN - k) // A.UP + A.TAPS - 1] for k in range(len(h)) if (m * A.DOWN - k) % A.UP == 0)
        assert abs(whole[m] - want) < 1e-4
    got = whole[(A.TAPS // A.DOWN) * A.UP :]
    part = got[: A.FRAME].astype(float)
    part = (part - part.mean()) * np.hanning(A.FRAME + 1)[:-1]
    n = np.arange(A.FRAME)
    power = [abs(np.sum(part * np.exp(-2j * np.pi * f * n / A.FRAME))) ** 2 for f in range(A.FRAME // 2 + 1)]
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 60 / 700), 2595 * np.log10(1 + 4000 / 700), A.BANDS + 2) / 2595) - 1)
    want = []
    for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
        want.append(sum(p * max(0, min((f * 8000 / A.FRAME - lo) / (mid - lo), (hi - f * 8000 / A.FRAME) / (hi - mid))) for f, p in enumerate(power)))
    assert np.allclose(A.log_mel(x.tobytes())[0], 10 * np.log10(np.array(want) + 1e-6), atol=0.05)


def test_media_table_is_what_the_features_read(spark):
    media = A.stored(docs(spark, {1: prose(1, 50)}, {"media": 5, "n_bytes": 7}))
    assert media.columns == ["doc_id", "n_bytes", "media"]
    other = media.withColumn("media", F.lit(A.to_wav(b"q" * 192)))
    row = A.features(other).first()
    assert row.payload_sha256 == hashlib.sha256(b"q" * 192).hexdigest() and row.feature != A.features(media).first().feature


CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "~0", "~1", "~", "<", "[", "\\", "<</SYS>>", "\n", "a", "é"]


def test_chats_round_trip(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "sys</s>tem", None]), r.choice([None, "".join(r.choice(CONTROL) for _ in range(r.randint(0, 9)))])) for c in range(60) for t in range(r.randint(1, 5))]
    rows += [(70, 0, "user", "x" * 100_000), (71, 1, "assistant", "b"), (71, 1, "assistant", "b"), (71, 0, "user", "a"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    chats = C.formatted(turns)
    got = {x.conv_id: x for x in C.read_back(chats).collect()}
    forms = {x.conv_id: x for x in chats.collect()}
    back = lambda s: s.replace("~1", "<").replace("~2", "[").replace("~0", "~")
    for c in {x[0] for x in rows}:
        mine = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
        g, f = got[c], forms[c]
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert g.n_turns == len(mine)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert "".join(back(f.formatted[s.start : s.end]) for s in f.loss_spans) == loss
        assert f.formatted.count("</s>") == len(mine) and g.formatted_chars == len(f.formatted)
    assert C.read_back(C.formatted(turns.limit(0))).count() == 0


def test_permutation():
    for size in (1, 2, 3, 10, 1000, 65537):
        keys = O.round_keys(5)
        p = O.permuted(np.arange(size), size, keys)
        assert sorted(p.tolist()) == list(range(size)) and (O.restored(p, size, keys) == np.arange(size)).all()
    assert (O.permuted(np.arange(1000), 1000, O.round_keys(1)) != O.permuted(np.arange(1000), 1000, O.round_keys(2))).any()


def test_training_order(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = {k: prose(k, 200 + k) for k in range(40)} | {90: None, 91: "", 92: prose(5, 20_000)}
    df = docs(spark, texts, {"shard": 1, "ids": 2})
    rows, manifest = O.materialise(df.unionByName(df.where("doc_id = 3")), path, fresh_dir(spark, "order"), shard_bytes=20_000)
    rows, listed = rows.collect(), [tuple(m) for m in manifest.collect()]
    assert len(listed) > 2 and sorted(r.slot for r in rows) == list(range(len(rows)))
    by = {r.slot: r for r in rows}
    for start in (0, 7, len(rows) // 2):
        for k, ids in enumerate(O.read(listed, start, 60)):
            r = by[start + k]
            assert len(ids) == O.LENGTH and zlib.crc32(ids[: r.n_ids].tobytes()) == r.crc32 and not ids[r.n_ids :].any()
    from stallwright.llm.tokenizer import encoder

    mine = sorted((r for r in rows if r.doc_id == 92), key=lambda r: r.seq)
    ids = np.concatenate([next(O.read(listed, r.slot, 1))[: r.n_ids] for r in mine])
    assert ids.tolist() == [*encoder(path)(texts[92]), 0]
    assert O.materialise(df.limit(0), path, fresh_dir(spark, "order"))[0].count() == 0


def test_slots_are_the_feistel_image_of_dense_numbers(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs(spark, {k: prose(k, 300) for k in range(30)})
    tasks = O.numbered(df.select("doc_id", "text"), path, fresh_dir(spark, "order"), 64)
    total = sum(n for *_, n in tasks)
    rows, manifest = O.materialise(df, path, fresh_dir(spark, "order"), length=64, shard_bytes=2_560)
    rows, listed = rows.collect(), sorted(manifest.collect(), key=lambda m: m[2])
    back = O.restored(np.array([r.slot for r in rows]), total, O.round_keys(O.KEY))
    assert sorted(back.tolist()) == list(range(total))
    by = {(r.doc_id, r.seq): int(n) for r, n in zip(rows, back)}
    assert all(by[d, s] + 1 == by[d, s + 1] for d, s in by if (d, s + 1) in by)  # numbers follow the texts
    assert [m[2] for m in listed] == list(range(0, total, 20)) and [m[3] for m in listed[:-1]] == [20] * (len(listed) - 1)


def test_token_ends_give_the_ids_back(spark, tmp_path):
    from stallwright.llm.tokenizer import encoder, id_type, token_bytes

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "a", " internationally responsibilities", "é ü\n\n x", "<|endoftext|> z", "\u6f22\u5b57 " * 9, prose(3, 500), "  \t "]
    out = O.Cuts(f"file://{tmp_path}/c", token_bytes(path))
    out.open_output()
    for t in texts:
        out.put(t.encode(), np.asarray(encoder(path)(t), np.int64))
    out.close_output()
    again = O.Cuts(f"file://{tmp_path}/c", token_bytes(path))
    again.open_input()
    assert [again.get(t.encode()).tolist() for t in texts] == [encoder(path)(t).tolist() for t in texts]
    assert id_type(path) == "<u2"
    again.open_input()
    with pytest.raises(ValueError, match="changed"):
        for t in texts:
            again.get((t + "zq").encode())


def test_chat_loss_is_cut_out_by_the_spans(spark):
    rows = [(1, 0, "user", "h\U0001f600i"), (1, 1, "assistant", "a</s>~1\U0001f600"), (1, 2, "assistant", "[INST] b"), (2, 0, "user", "none")]
    chats = C.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    want = "a</s>~1\U0001f600[INST] b"
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in C.read_back(chats).collect()}
    assert got == {1: (len(want), hashlib.sha256(want.encode()).hexdigest()), 2: (0, hashlib.sha256(b"").hexdigest())}
    fewer = chats.withColumn("loss_spans", F.slice("loss_spans", 1, 1))
    assert {r.conv_id: r.loss_chars for r in C.read_back(fewer).collect()} == {1: 8, 2: 0}
