import sys
import zlib

import corpus_pipeline
from helpers import docs, prose

from stallwright.llm import decontamination, near_dedup, packing, pii, toxicity


def test_pipeline_equals_brute_force(spark, tmp_path):
    texts = {k: prose(k, 80) + (" vilestema" if k % 4 == 0 else "") for k in range(600)}
    texts |= {700: texts[1], 701: texts[2] + " tail", 702: prose(900, 40) + " " + prose(77, 30), 703: "write to a@b.co or " + prose(5000, 60), 704: None, 705: ""}
    df = docs(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, int(k % 4 == 0)) for k in range(600)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [("1", prose(77, 30))]
    spark.createDataFrame([(1, prose(77, 30))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    train = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 != 1]
    import numpy as np

    m = toxicity.fit([toxicity.terms(texts[k]) for k in train], [toxicity.word_ids(texts[k]) for k in train], np.array([float(k % 4 == 0) for k in train]))
    left = {k: t for k, t in texts.items() if m.score(toxicity.terms(t)) < toxicity.CUT}
    assert not any(k < 600 and k % 4 == 0 for k in left) and len(left) >= 450
    kept = set(near_dedup.brute_force(left).values())
    left = {k: t for k, t in left.items() if k in kept}
    assert 700 not in left and 701 not in left
    left = {k: t for k, t in left.items() if not decontamination.brute_force(t, items)[1]}
    assert 702 not in left
    left = {k: pii.masked(t) for k, t in left.items()}
    assert "<EMAIL>" in left[703]
    want = packing.pieces(docs(spark, left), sys.modules["public_tokenizers"].path("byte_bpe_50k.json")).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_stages_keep_the_columns(spark, tmp_path):
    df = docs(spark, {1: "a b c", 2: None})
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns


def test_stages_on_an_empty_table_long_texts_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(77, 30))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs(spark, {1: prose(1, 60_000), 2: prose(2, 50), 3: None, 4: ""}, {"digest": 1, "_x0": 2, "score": 3, "spans": 4, "shard": 5})
    for rows, n in ((df.limit(0), {0}), (df.unionByName(df), {3, 4, 8})):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == df.columns and out.count() in n
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).select("doc_id").distinct().count() == (4 if n != {0} else 0)
