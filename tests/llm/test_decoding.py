"""The pipeline's last stage encodes and decodes."""

import hashlib

import corpus_pipeline


def test_last_stage_decodes(spark):
    rows = [(1, "the cat of  the house, 漢字 🙂\n"), (2, ""), (3, None), (4, "a" * 3000)]
    got = corpus_pipeline.bpe_encoding(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in rows}
